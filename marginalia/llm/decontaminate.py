"""Benchmark decontamination: a prefix-filtered set join of word windows.

Items are cut in windows of `WORDS` consecutive words (a shorter item is one window). Words are ordered by how often
they occur in all documents. A document can only hold a window if it holds the window's first word in that order, its
rarest one, so that only the places of these words are candidates. Bounds on position and length leave out candidates
where no whole window fits; the rest are verified word by word around the place.

Native expressions only. The items' words are a set literal, and their anchors broadcast, while there are at most
`SMALL` of them (this is counted); beyond that both are joined by shuffles. No document text is shuffled in the first
case, and a document's verified places are aggregated before they are.

Null texts have no words, and items without words no windows. Items with the same id count once, and rows of documents
that repeat key and text give one row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 13
SMALL = 50_000
#: A name for what `clean` adds, which no input column may have.
_ROW = "__text_row"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _number(text: Column) -> Column:
    """A number of a row's text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def anchors(items: DataFrame, counts: DataFrame, size: int = WORDS) -> DataFrame:
    """The rarest word of each window: w, item, its number in the item, and up to size-1 words to both sides of it.

    items: item, ws. counts: w, n (words of no document are left out, as then no document holds the window).
    """
    each = items.select("item", F.posexplode("ws").alias("at", "w")).join(counts, "w", "left").select("item", "at", "w", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    ranked = each.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n", "w"))), lambda x: x).alias("rs"))
    long = F.least(F.lit(size), F.size("rs"))
    starts = F.sequence(F.lit(1), F.size("rs") - long + 1)
    rarest = F.transform(starts, lambda s: F.array_min(F.transform(F.slice("rs", s, long), lambda x: F.struct(x["n"].alias("n"), x["w"].alias("w"), x["at"].alias("at")))))
    at = ranked.select("item", F.col("rs")["w"].alias("ws"), F.explode(F.array_distinct(rarest)).alias("x")).where(F.col("x")["n"] > 0)
    place = F.col("x")["at"]
    begin = F.greatest(place - (size - 1), F.lit(0))
    return at.select(
        F.col("x")["w"].alias("w"), "item", place.alias("at"), F.size("ws").alias("length"),
        F.reverse(F.slice("ws", begin + 1, place - begin)).alias("left"), F.slice("ws", place + 2, size - 1).alias("right"),
    )


def _agreeing(a: Column, b: Column) -> Column:
    """How many first elements of two arrays are equal."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    first = F.array_position(same, False).cast("int")
    return F.when(first > 0, first - 1).otherwise(n)


def places(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, size: int = WORDS, small: int = SMALL) -> DataFrame:
    """Key, row, n_words, and of each verified place its first and last word (from 0) and the item; nulls for none."""
    items = benchmark.select(F.col(item).alias("item"), words(F.col(item_text)).alias("ws")).where((F.size("ws") > 0) & F.col("item").isNotNull()).dropDuplicates(["item", "ws"])
    items = items.withColumn("item", F.struct("item", F.xxhash64("ws").alias("x")))  # items with one id but two texts stay apart
    texts = docs.select(F.col(key).alias("key"), _number(F.col(text)).alias("row"), words(F.col(text)).alias("ws"))
    vocabulary = items.select(F.explode("ws").alias("w")).distinct()
    n_places = items.agg(F.coalesce(F.sum(F.size("ws")), F.lit(0)).alias("n")).first()["n"]
    if n_places <= small:
        listed = sorted(r["w"] for r in vocabulary.collect())
        held = texts.select(F.explode(F.filter("ws", lambda w: w.isin(listed))).alias("w")) if listed else vocabulary
    else:
        held = texts.select(F.explode("ws").alias("w")).join(vocabulary, "w", "left_semi")
    keys = anchors(items, held.groupBy("w").agg(F.count("*").alias("n")), size)
    around = lambda p: (F.reverse(F.slice("ws", F.greatest(p - (size - 2), F.lit(1)), F.least(p, F.lit(size - 1)))), F.slice("ws", p + 2, size - 1))
    if n_places <= small:
        rows = sorted(keys.collect(), key=lambda r: (r["w"], str(r["item"]), r["at"]))
        keys = F.broadcast(docs.sparkSession.createDataFrame(rows, keys.schema))
        chosen = sorted({r["w"] for r in rows})
        texts = texts.withColumn("n_words", F.size("ws").cast("long"))
        numbered = F.transform("ws", lambda w, i: F.when(w.isin(chosen), i)) if chosen else F.array().cast("array<int>")
        found = texts.select("key", "row", "n_words", "ws", F.array_compact(numbered).alias("ps"))
        near = F.transform("ps", lambda p: F.struct(p.alias("p"), F.col("ws")[p].alias("w"), around(p)[0].alias("l"), around(p)[1].alias("r")))
        found = found.select("key", "row", "n_words", F.explode_outer(near).alias("c")).select("key", "row", "n_words", "c.*")
        joined = found.join(keys, "w", "left")
    else:
        at = texts.select("key", "row", F.posexplode("ws").alias("p", "w")).join(keys.select("w").distinct(), "w", "left_semi")
        at = at.groupBy("key", "row").agg(F.collect_set("p").alias("ps"))
        near = F.transform("ps", lambda p: F.struct(p.alias("p"), F.col("ws")[p].alias("w"), around(p)[0].alias("l"), around(p)[1].alias("r")))
        same = F.col("t.key").eqNullSafe(F.col("u.key")) & (F.col("t.row") == F.col("u.row"))
        found = texts.dropDuplicates(["key", "row"]).alias("t").join(at.alias("u"), same).select("t.key", "t.row", "ws", "ps").withColumn("n_words", F.size("ws").cast("long"))
        found = found.select("key", "row", "n_words", F.explode(near).alias("c")).select("key", "row", "n_words", "c.*")
        none = texts.select("key", "row", F.size("ws").cast("long").alias("n_words"))
        joined = found.join(keys, "w").unionByName(none, allowMissingColumns=True)
    whole = F.least(F.col("length"), F.lit(size))
    # a whole window must fit between the ends of the document and those of the item
    fits = F.least("p", "at") + F.least(F.col("n_words") - 1 - F.col("p"), F.col("length") - 1 - F.col("at")) + 1 >= whole
    left, right = _agreeing(F.col("l"), F.col("left")), _agreeing(F.col("r"), F.col("right"))
    checked = joined.withColumns({"a": F.when(fits, left), "b": F.when(fits, right)})
    hit = F.when(F.col("a") + F.col("b") + 1 >= whole, F.struct((F.col("p") - F.col("a")).alias("first"), (F.col("p") + F.col("b")).alias("last")))
    return checked.select("key", "row", "n_words", hit.alias("hit"), F.when(hit.isNotNull(), F.col("item")["item"]).alias("item"))


def _found(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, size: int, small: int) -> DataFrame:
    """As report, with the number of the row's text; the key is named key."""
    by = places(docs, benchmark, key, text, item, item_text, size, small).groupBy("key", "row")
    found = by.agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))

    def add(seen, hit):
        fresh = F.greatest(hit["last"].cast("long") - F.greatest(hit["first"].cast("long") - 1, seen["end"]), F.lit(0).cast("long"))
        return F.struct((seen["n"] + fresh).alias("n"), F.greatest(seen["end"], hit["last"].cast("long")).alias("end"))

    return found.select("key", "row", "n_words", F.aggregate("hits", zero, add, lambda s: s["n"]).alias("n_hit"), "items")


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WORDS, small: int = SMALL) -> DataFrame:
    """Key, n_words, n_hit (words inside any window's occurrence) and items (sorted ids of items with such windows)."""
    found = _found(docs, benchmark, key, text, item, item_text, size, small)
    return found.select(F.col("key").alias(key), "n_words", "n_hit", "items")


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """Whether a twentieth or more of a document's words are hit, and one at least."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated: each is judged by its own text, whatever its key (null too)."""
    found = _found(docs, benchmark, key, text, item, item_text, WORDS, SMALL)
    bad = found.where(contaminated(F.col("n_words"), F.col("n_hit"))).select("key", "row")
    marked = docs.withColumn(_ROW, _number(F.col(text)))
    return marked.join(bad, marked[key].eqNullSafe(bad["key"]) & (marked[_ROW] == bad["row"]), "left_anti").drop(_ROW)


def sql() -> str:
    """Windows of documents and items side by side, without candidates."""
    listed = lambda t, i: f"SELECT {i} AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM {t}"
    window = lambda n: f"array_to_string(ws[s:s + {n} - 1], ' ')"
    return f"""
        WITH d AS ({listed("documents", "doc_id")}), b AS ({listed("benchmark", "item_id")}),
        lens AS (SELECT *, least(len(ws), {WORDS}) AS n FROM b WHERE len(ws) > 0),
        i AS (SELECT DISTINCT id, n, {window("n")} AS w FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM lens)),
        sizes AS (SELECT DISTINCT n FROM i),
        x AS (SELECT id, n, s, {window("n")} AS w FROM (SELECT d.id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n)),
        m AS (SELECT x.id, x.s, x.n, i.id AS item FROM x JOIN i ON x.w = i.w AND x.n = i.n),
        p AS (SELECT id, count(DISTINCT q) AS n FROM (SELECT id, unnest(range(s, s + n)) AS q FROM m) GROUP BY id),
        a AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM m) GROUP BY id)
        SELECT d.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(a.n, 0) AS BIGINT) AS n_items,
               sha256(coalesce(a.items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN p ON p.id = d.id LEFT JOIN a ON a.id = d.id"""
