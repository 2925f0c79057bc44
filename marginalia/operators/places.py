"""Matches of patterns with their places, as rows: the span generator of all detection, in native expressions.

`matches` gives one row for each match of each form in a text. Places are running sums over what stands between matches
and the matches themselves, in two levels, so that many matches take linear time. Texts stay in
their row: what leaves it is the match and the text around it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import COMPOUND, SURNAME, jvm

#: Characters around a match that it carries, matches whose places are summed at a time, characters of a piece of text.
AROUND, BLOCK, PIECE, SHORT = 100, 128, 4096, 800
#: Estimated bytes of matches for a task, and an estimate that says nothing.
TASK, UNKNOWN = 2_000_000, 1 << 50
#: Marks of matches, which no text should hold; one that does is searched turn by turn.
_OPEN, _SHUT = "\ufdd0", "\ufdd1"
#: What names a row of the input: key, hash of the text, and a number that tells alike rows apart.
HASH, ROW = "_hash", "_row"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, jvm(r"^\s+|\s+$"), "")


def group(text: Column, pattern: str, flags: str, number: int) -> Column:
    """A group of a match. What stood before it isn't known any more, and was tested."""
    return F.regexp_extract(text, jvm(f"^(?:{pattern.removeprefix(chr(92) + 'b')})", flags), number)


def fits(text: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(text, F.lit(jvm(pattern, flags)))


def some(text: Column) -> Column:
    """Null where it is empty, as groups are that take no part."""
    return F.when(text != "", text)


def _summed(steps: Column, begin: Column) -> Column:
    """start and raw of each step (gap, raw) from a place on."""
    zero = F.struct(begin.alias("at"), F.array().cast("array<struct<start: int, raw: string>>").alias("out"))

    def add(seen, x):
        start = seen["at"] + x["gap"]
        return F.struct((start + F.length(x["raw"])).alias("at"), F.concat(seen["out"], F.array(F.struct(start.alias("start"), x["raw"].alias("raw")))).alias("out"))

    return F.aggregate(steps, zero, add, lambda s: s["out"])


def _turns(text: Column, pattern: str, flags: str) -> Column:
    """gap and raw of all matches: each is looked for where the last one ended."""
    step = jvm(rf"\G([\s\S]*?)(?:{pattern})", flags)
    found = (F.regexp_extract_all(text, F.lit(step), g) for g in (0, 1))
    return F.zip_with(*found, lambda m, g: F.struct(F.length(g).alias("gap"), F.substring(m, F.length(g) + 1, F.length(m)).alias("raw")))


def _hint(pattern: str, flags: str) -> str:
    """What must stand where a match begins, if it begins with a name: most places are told by a letter."""
    if flags or not pattern.startswith(r"\b("):
        return ""
    if pattern[3:].startswith(SURNAME):
        return "(?=[A-ZÀ-Ÿ])"
    # up to two particles before it
    return r"(?=['’A-ZÀ-Ÿ]|[a-z]{1,5}(?:['’][ts])?\s+(?:['’]?[A-Za-z]{1,5}(?:['’][ts])?\s+)?[A-ZÀ-Ÿ])" if pattern[3:].startswith(COMPOUND) else ""


def _steps(text: Column, pattern: str, flags: str) -> Column:
    """gap (characters since the last match) and raw of all matches; null without any.

    They are marked in the text, in one run, which is then cut at the marks.
    """
    step = lambda p, at: F.struct((at - 1).alias("gap"), F.substring(p, at + 1, F.length(p)).alias("raw"))
    cut = lambda m: F.transform(F.slice(m, 1, F.size(m) - 1), lambda p: step(p, F.instr(p, _OPEN)))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731 (a value that is used more than once is made once)
    marked = F.regexp_replace(text, jvm(_hint(pattern, flags) + pattern, flags), f"{_OPEN}$0{_SHUT}")
    steps = once(marked, lambda m: F.when(F.contains(m, F.lit(_SHUT)), once(F.split(m, _SHUT, -1), cut)))
    turns = once(_turns(text, pattern, flags), lambda t: F.when(F.size(t) > 0, t))
    return F.when(F.rlike(text, F.lit(f"[{_OPEN}{_SHUT}]")), turns).otherwise(steps)


def inside(text: Column, pattern: str, flags: str = "") -> Column:
    """start and raw of the matches in a short text."""
    none = F.array().cast("array<struct<gap: int, raw: string>>")
    return _summed(F.coalesce(_steps(text, pattern, flags), none), F.lit(0))


def named(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """The key, what names the row, the text (null: empty) and further columns."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key), F.xxhash64(body).alias(HASH), F.monotonically_increasing_id().alias(ROW), body.alias("_text"), *more)


def matches(rows: DataFrame, key: str, forms: Sequence[tuple[str, str]], needs: dict[int, tuple[str, ...]] | None = None, more: Sequence[str] = ()) -> DataFrame:
    """form (its number), start, raw and around (the match with `AROUND` characters on both sides) for rows of `named`.

    needs: patterns of cheap tests without all of which a form isn't looked for.
    """
    ids, needs = [key, HASH, ROW, *more], needs or {}

    def found(i, pattern, flags):
        every, tests = _steps(F.col("_text"), pattern, flags), [F.col(f"_needs{all_needs.index(n)}") for n in needs.get(i, ())]
        return F.when(reduce(lambda a, b: a & b, tests), every) if tests else every

    all_needs = sorted({n for some_needs in needs.values() for n in some_needs})
    tested = rows.select(*ids, "_text", *(fits(F.col("_text"), n).alias(f"_needs{i}") for i, n in enumerate(all_needs)))
    each = F.array(*(F.struct(F.lit(i).alias("form"), found(i, p, f).alias("steps")) for i, (p, f) in enumerate(forms)))
    by_form = tested.select(*ids, "_text", F.explode(F.filter(each, lambda f: f["steps"].isNotNull())).alias("f")).select(*ids, "_text", "f.form", "f.steps")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("steps") - 1) / BLOCK).cast("int")), lambda b: F.slice("steps", b * BLOCK + 1, F.lit(BLOCK)))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("_text") / PIECE).cast("int")), lambda i: F.substring("_text", i * PIECE + 1, F.lit(PIECE + SHORT + 2 * AROUND)))
    by_form = by_form.select(*ids, "_text", "form", blocks.alias("blocks"), pieces.alias("pieces"))
    length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["raw"]))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    begins = F.aggregate(F.transform("blocks", length), zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    placed = by_form.select(*ids, "_text", "form", "pieces", F.flatten(F.zip_with("blocks", begins, _summed)).alias("placed"))

    def shown(x):
        begin, end = F.greatest(x["start"] - AROUND, F.lit(0)), x["start"] + F.length(x["raw"]) + AROUND
        piece = F.get("pieces", F.floor(begin / PIECE).cast("int"))
        near = F.substring(piece, begin % PIECE + 1, end - begin)
        return F.struct("form", x["start"].alias("start"), x["raw"].alias("raw"), F.when(F.length(x["raw"]) <= SHORT, near).otherwise(F.substring("_text", begin + 1, end - begin)).alias("around"))

    return placed.select(*ids, F.explode(F.transform("placed", shown)).alias("m")).select(*ids, "m.*")


def around(outer: Column, start: Column, end: Column, outer_start: Column) -> Column:
    """The text around a span that lies in a match, from the text around the match."""
    begin = F.greatest(start - AROUND, F.lit(0))
    return F.substring(outer, begin - F.greatest(outer_start - AROUND, F.lit(0)) + 1, end + AROUND - begin)


class Rows:
    """Windows over the rows of a document."""

    def __init__(self, key: str):
        self.ids = [key, HASH, ROW]

    def together(self, df: DataFrame) -> DataFrame:
        """The rows of a document in one partition: it is the only exchange that the steps over them need.

        Partitions follow from the estimated bytes of the rows: by the bytes that are exchanged, which pack well, windows
        would sort some gigabytes in a task.
        """
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if size >= UNKNOWN:
            return df.repartition(*self.ids[:2])
        return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK)), *self.ids[:2])

    def by(self, *columns: str) -> Window:
        return Window.partitionBy(*self.ids, *columns)

    def first(self, df: DataFrame, by: Sequence[str], order: str = "order") -> DataFrame:
        """Of the rows of a document that are alike in some columns the first in order."""
        return df.withColumn("_turn", F.row_number().over(self.by(*by).orderBy(order))).where("_turn = 1").drop("_turn")

    def reached(self, df: DataFrame, counts: Column) -> Column:
        """The greatest end of rows that count and start at or before a row's start."""
        return F.max(F.when(counts, F.col("end"))).over(self.by().orderBy("start").rangeBetween(Window.unboundedPreceding, 0))

    def next_start(self, counts: Column) -> Column:
        """The least start of rows that count and start after a row's start."""
        return -F.max(F.when(counts, -F.col("start"))).over(self.by().orderBy(-F.col("start")).rangeBetween(Window.unboundedPreceding, -1))
