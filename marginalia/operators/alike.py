"""Equal texts are worked on once: an operator runs on each different text, and its rows go to all rows that hold it.

Texts meet by a digest. It costs one exchange of the texts and one of their keys, and pays where texts come again: copies
of papers, or texts of single citations and entries. Where all texts differ an operator does the same work as without it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What names a text, and the further inputs that belong to it.
SAME = "_same"
#: What names the columns that a text is made of.
MADE = "_made"


def digest(text: str, *more: str) -> Column:
    """What equal texts (null: empty) with equal further inputs have in common."""
    of = _hashed(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.struct(of.alias("text"), *more) if more else of


def _hashed(text: Column) -> Column:
    # never null, or a join on it would first test that it isn't: down at the scan, for which texts are made once more
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def different(docs: DataFrame, text: str, *more: str) -> DataFrame:
    """Each different text (null: empty) once, with its digest and further inputs."""
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text), *more).distinct()
    return texts.withColumn(SAME, digest(text, *more))


def once(docs: DataFrame, key: str, text: str, run: Callable[[DataFrame, str], DataFrame], *more: str) -> DataFrame:
    """The rows that run gives for texts (a frame and the name of its key), for each row of docs with its key."""
    found = run(different(docs, text, *more), SAME)
    return docs.select(key, digest(text, *more).alias(SAME)).join(found, SAME).drop(SAME)


def once_by(rows: DataFrame, key: str, made_of: Sequence[str], run: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows that run gives for the different values of columns (a frame with them, and the name of its key), for each row with its key.

    Rows meet what was found by these values, and by a digest of them where they hold arrays or are numbers only, which sorts
    faster than they do.
    """
    kinds = [rows.schema[c].dataType.simpleString() for c in made_of]
    if all(k in ("bigint", "int", "boolean") for k in kinds):
        of = _hashed(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in made_of)))
    else:
        of = _hashed(F.to_json(F.struct(*made_of))) if any(k.startswith("array") for k in kinds) else F.struct(*made_of)
    # the filter keeps Spark from taking this for a part of the distinct texts that follow, for which it would make all rows' texts
    values = rows.groupBy(*made_of).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 0")
    return rows.select(key, of.alias(MADE)).join(run(values.select(of.alias(MADE), *made_of), MADE), MADE).drop(MADE)


def once_made(rows: DataFrame, key: str, made_of: Sequence[str], given: dict[str, Column], run: Callable[[DataFrame, str], DataFrame], differ: bool = False, **first: Column) -> DataFrame:
    """As once, for texts that are made of columns: given (the text, then further inputs) is made once for each of their values.

    No row's text is made where it meets what was found. differ: texts of different values differ (but for a few), so that
    they aren't compared once more, for which each is made again and exchanged.
    first: columns, by name, that are made of these values before what is given, which may use them several times.
    """
    text, *more = given

    def found(values: DataFrame, name: str) -> DataFrame:
        texts = values.select("*", *(c.alias(n) for n, c in first.items())).select(name, *(c.alias(n) for n, c in given.items()))
        return run(texts, name) if differ else once(texts, name, text, run, *more)

    return once_by(rows, key, made_of, found)
