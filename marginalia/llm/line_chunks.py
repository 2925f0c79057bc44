"""Removal of repeated passages of several lines, in chunks whose bounds the content chooses.

Each line is hashed; a rolling hash over `WINDOW` line hashes has a local minimum every few lines, and a chunk ends
there, so that an insertion moves no bounds beyond its neighbourhood. Chunks of two lines or more that stand elsewhere
too, byte for byte, are removed in all places but the first (smallest key, then first place).

A chunk at the rim of a passage runs into the document's own lines and so matches nothing. Passages are therefore also
matched by windows, from each line that isn't blank to the next such line, so that a repeated run of two lines or more
that aren't blank is removed whole. Each removed line stands elsewhere before. `passages=False` leaves windows out, which
is what `SQL` says.

Hashes find the chunks and windows that may repeat; only their texts are shuffled and compared, after partial aggregation,
so that a chunk in a third of all documents is one row per task. What is joined back to the places of a chunk is dealt
with a salt where they are more than `HOT`; the hashes of such chunks, `MOST_HOT` at most as the bound on places grows
with their number, are broadcast. Native expressions only; hashes and places are written once to the shared folder.

Null texts count as empty; texts of one line and chunks of blank lines stay. Rows with a null key stay as they are.
Repeated rows (key and text) are one document. Other columns are kept by `clean` and don't matter, but that its counts
stand in place of columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables

WINDOW, BASE, PRIME = 2, 131, 268_435_399
#: Places of a chunk that one task takes, and chunks that may have more.
HOT, MOST_HOT = 20_000, 10_000
#: Names of the operator's own columns.
_KEY, _ROW, _WHOLE = "__chunk_key", "__chunk_row", "__chunk_whole"


def rolling(hashes: Column) -> Column:
    """For each line, the polynomial hash of its hash and the one before."""
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))
    return F.zip_with(hashes, before, lambda x, y: (x + y * BASE) % PRIME)


def bounds(rolled: Column) -> Column:
    """Numbers of the lines that end a chunk: local minima but for the first line, and the last line."""
    n, far = F.size(rolled), F.array(F.lit(1 << 40))
    before = F.concat(far, F.slice(rolled, 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(rolled, 2, F.greatest(n - 1, F.lit(0))), far)
    rows = F.arrays_zip(rolled.alias("r"), before.alias("b"), after.alias("a"), F.sequence(F.lit(0), n - 1).alias("i"))
    ends = F.filter(rows, lambda x: ((x["i"] > 0) & (x["r"] < x["b"]) & (x["r"] <= x["a"])) | (x["i"] == n - 1))
    return F.transform(ends, lambda x: x["i"])


def chunked(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key, a number for the row's text, its lines, and chunks: array of (first line, last line), from 0."""
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)
    df = df.select(F.col(key).alias(_KEY), F.xxhash64(F.col(text)).alias(_ROW), lines.alias("lines"))
    df = df.withColumn("h", F.transform("lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long")))
    df = df.select(_KEY, _ROW, "lines", rolling(F.col("h")).alias("r"))
    df = df.select(_KEY, _ROW, "lines", bounds(F.col("r")).alias("ends"))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda x: x + 1))
    return df.select(_KEY, _ROW, "lines", F.zip_with(starts, "ends", lambda s, e: F.struct(s.alias("s"), e.alias("e"))).alias("chunks"))


def _text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["s"] + 1, chunk["e"] - chunk["s"] + 1), "\n")


def _filled(text: Column) -> Column:
    return F.trim(F.translate(text, "\n\t\r", "")) != ""


def filled(lines: Column) -> Column:
    """Numbers of the lines that aren't blank."""
    return F.array_compact(F.transform(lines, lambda x, i: F.when(_filled(x), i)))


def windows(numbers: Column) -> Column:
    """Array of (first line, last line) from each of the lines to the next one."""
    n = F.greatest(F.size(numbers) - 1, F.lit(0))
    return F.zip_with(F.slice(numbers, 1, n), F.slice(numbers, 2, n), lambda s, e: F.struct(s.alias("s"), e.alias("e")))


def removals(df: DataFrame, key: str = "doc_id", text: str = "text", passages: bool = True, hot: int = HOT) -> DataFrame:
    """Key, row number and __removed: array of the chunks and windows (first line, last line) of a document that stand elsewhere before."""
    docs, tables = chunked(df.where(F.col(key).isNotNull()), key, text), Tables(df.sparkSession)
    many = F.filter("chunks", lambda c: c["e"] > c["s"])
    if passages:
        docs = docs.withColumn("filled", filled(F.col("lines")))
        many = F.concat(many, windows(F.col("filled")))
    # the lambda keeps the rest of the plan out of the loop over what is exploded
    found = docs.select(_KEY, _ROW, "lines", F.explode(many).alias("c")).select(_KEY, _ROW, "c", _text(F.col("lines"), F.col("c")).alias("t")).where(_filled(F.col("t")))
    coded = tables.keep(found.select(_KEY, _ROW, "c", F.xxhash64("t").alias("code")))
    place = F.struct(F.col(_KEY), F.col("c")["s"].alias("s"), F.col(_ROW))
    codes = coded.groupBy("code").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where(F.col("a") != F.col("b")).select("code", "n")
    codes = tables.keep(codes)
    bound = max(hot, -(-coded.count() // MOST_HOT))
    salts = codes.where(F.col("n") > bound).select("code", F.ceil(F.col("n") / bound).cast("int").alias("salts"))
    dealt = lambda d: d.join(F.broadcast(salts), "code", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = lambda d: dealt(d).withColumn("salt", F.pmod(F.xxhash64(_KEY, _ROW), F.col("salts")).cast("int")).drop("salts")
    each = lambda d: dealt(d).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    maybe = own(coded).join(each(codes.select("code")), ["code", "salt"], "left_semi").groupBy(_KEY, _ROW).agg(F.collect_set(F.struct("c", "code")).alias("cs"))
    again = docs.select(_KEY, _ROW, "lines").join(maybe, [_KEY, _ROW]).dropDuplicates([_KEY, _ROW])
    texts = again.select(_KEY, _ROW, "lines", F.inline("cs")).select(_KEY, _ROW, "c", "code", _text(F.col("lines"), F.col("c")).alias("t"))
    first = texts.groupBy("code", "t").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last"))
    gone = own(texts).join(each(first.select("code", "t", "first")), ["code", "salt", "t"]).where(place != F.col("first"))
    # of equal lines in a row, windows that reach into the first one stay
    same = (F.col(_KEY) == F.col("first")[_KEY]) & (F.col(_ROW) == F.col("first")[_ROW])
    gone = gone.where(~(same & (F.col("c")["s"] <= F.col("first")["s"] + F.col("c")["e"] - F.col("c")["s"])))
    return gone.groupBy(_KEY, _ROW).agg(F.collect_set("c").alias("__removed"))


def clean(df: DataFrame, key: str = "doc_id", text: str = "text", passages: bool = True, hot: int = HOT) -> DataFrame:
    """All rows and columns of df, the text without its removed chunks and windows; and n_lines and n_lines_removed."""
    gone = removals(df, key, text, passages, hot)
    rows = df.select(F.col(key).alias(_KEY), F.xxhash64(F.col(text)).alias(_ROW), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(_WHOLE)).join(gone, [_KEY, _ROW], "left")
    whole = F.col(_WHOLE)[text]
    lines = F.split(F.coalesce(whole.cast("string"), F.lit("")), "\n", -1)
    numbers = F.array_distinct(F.flatten(F.transform("__removed", lambda c: F.sequence(c["s"], c["e"]))))
    rows = rows.withColumn("__lines", lines).withColumn("__numbers", numbers)
    kept_numbers = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__numbers"))
    rest = F.transform(kept_numbers, lambda i: F.col("__lines")[i])
    stays = F.col("__removed").isNull()
    counts = {"n_lines": F.size("__lines").cast("long"), "n_lines_removed": F.when(stays, F.lit(0).cast("long")).otherwise(F.size("__numbers").cast("long"))}
    columns = {c: F.col(_WHOLE)[c] for c in df.columns} | {text: F.when(stays, whole).otherwise(F.array_join(rest, "\n"))} | counts
    return rows.select(*(c.alias(name) for name, c in columns.items()))


SQL = f"""
    WITH l AS (
        SELECT doc_id, list_aggregate(x, 'count') AS n, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
    h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l),
    r AS (SELECT *, (h + {BASE} * coalesce(lag(h) OVER w, 0)) % {PRIME} AS r FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    e AS (SELECT *, (i > 0 AND r < coalesce(lag(r) OVER w, {1 << 40}) AND r <= coalesce(lead(r) OVER w, {1 << 40})) OR lead(i) OVER w IS NULL AS ends
          FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    c AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
    k AS (SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n, min(i) AS s FROM c GROUP BY doc_id, c),
    g AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS place, trim(replace(replace(replace(t, chr(10), ''), chr(9), ''), chr(13), ''), ' ') AS seen FROM k),
    v AS (SELECT *, n > 1 AND seen <> '' AND rank() OVER (PARTITION BY t, n > 1 AND seen <> '' ORDER BY doc_id, s) > 1 AS gone FROM g)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS n_lines_removed,
           sha256(coalesce(string_agg(t, chr(10) ORDER BY s) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM v GROUP BY doc_id"""
