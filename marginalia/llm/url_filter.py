"""Weighted URL vocabulary.

An Aho-Corasick automaton finds all terms of a vocabulary in each lower-cased URL in one pass. A hit counts only where
neither neighbour is a letter or digit. A URL is rejected for one strict term, or for `min_soft` different soft terms;
repeats of one soft term count once. Explicit host and path rules stand above the vocabulary.

Null or empty URLs hit nothing and are allowed; repeated rows are judged alike; other columns of the input are ignored.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.batches import map_batches, slices

#: Stems whose forms make the vocabulary where none is given.
STRICT_STEMS = (
    "cheap-pills spam-farm porn xxx hardcore viagra cialis escort warez camgirl hentai milf nude gangbang crackz keygen serialz pirate-bay malware phish botnet ransom doorway linkfarm"
).split()
SOFT_STEMS = (
    "casino poker bet gamble slot jackpot lottery roulette win winner prize bonus free cheap discount deal pill pharma drug adult sexy dating hookup singles loan payday credit debt mortgage insurance"
    " click track ad ads popup banner spam crack torrent download stream hack proxy clone replica fake watch rolex diet slim miracle crypto coin invest rich cash money earn income survey"
).split()
ENDINGS = ("", "s", "er", "ers", "ing", "z", "4u", "online", "-online")
MIN_SOFT = 2
#: Terms that may be given, as the automaton goes to each task.
MOST_TERMS = 1_000_000


def forms(stems: list[str]) -> tuple[str, ...]:
    return tuple(sorted({stem + ending for stem in stems for ending in ENDINGS}))


STRICT = forms(STRICT_STEMS)
SOFT = tuple(sorted({*forms(SOFT_STEMS)} - {*STRICT}))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(terms: DataFrame, term: str = "term", strict: str = "strict") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table of terms and whether they are strict (null: not); empty and null terms go."""
    known = terms.select(F.lower(F.col(term).cast("string")).alias("t"), F.coalesce(F.col(strict).cast("boolean"), F.lit(False)).alias("s"))
    rows = known.where("t <> ''").groupBy("t").agg(F.max("s").alias("s")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple(sorted(r["t"] for r in rows if r["s"])), tuple(sorted(r["t"] for r in rows if not r["s"]))


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """None for no terms."""
    if not (strict or soft):
        return None
    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):  # a term in both lists is strict
        for term in terms:
            found.add_word(term, (weight, term))
    found.make_automaton()
    return found


def found_in(url: str, terms: ahocorasick.Automaton | None) -> tuple[list[str], list[str]]:
    """The different strict and soft terms of a URL, sorted."""
    if not url or terms is None:
        return [], []
    low, seen = url.lower(), (set(), set())
    edge = lambda i: not 0 <= i < len(low) or not (low[i].isascii() and low[i].isalnum())
    for end, (weight, term) in terms.iter(low):
        if edge(end + 1) and edge(end - len(term)):
            seen[weight == 1].add(term)
    return sorted(seen[0]), sorted(seen[1])


def hits(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[list[str], list[str]]:
    return found_in(url, automaton(strict, soft))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    known = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(known, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(known, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules `host/path` that covers a host (or a parent of it) and begins its path; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is tried first, as it wraps the others
        top, tail = rule.split("/", 1)
        out = F.when(((host == top) | host.endswith(f".{top}")) & path.startswith(f"/{tail}"), F.lit(rule)).otherwise(out)
    return out


def judge(
    df: DataFrame, key: str, url: str, rules: dict[str, str], strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, min_soft: int = MIN_SOFT
) -> DataFrame:
    """Key, host, path, rule, verdict (allow or block), strict_hits and soft_hits of each row. rules: host/path to verdict."""

    def run(batches):
        terms = automaton(strict, soft)  # once for each task
        for batch in slices(batches):
            found = [found_in(u or "", terms) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([x[i] for x in found], pa.list_(pa.string())) for i in (0, 1))], names=[key, "url", "strict_hits", "soft_hits"]
            )

    kind = df.schema[key].dataType.simpleString()
    out = map_batches(df.select(F.col(key), F.col(url).cast("string").alias("url")), run, f"`{key}` {kind}, url string, strict_hits array<string>, soft_hits array<string>")
    host, path = split_url(F.col("url"))
    out = out.withColumns({"host": host, "path": path}).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    spam = (F.size("strict_hits") >= 1) | (F.size("soft_hits") >= min_soft)
    return out.select(key, "host", "path", "rule", F.coalesce(ruled, F.when(spam, "block").otherwise("allow")).alias("verdict"), "strict_hits", "soft_hits")
