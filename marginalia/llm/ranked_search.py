"""Ranked lexical search: the best documents of each item, by WAND over shards of documents.

Two passes over the documents. The first writes, for each row, its number of terms and the items' terms that it holds,
with their counts; sums over that table give the corpus figures that impacts need. The second cuts the table into shards
of up to `SHARD` postings as a task reads it, lays each shard out as lists by term, in order of the key, with the impact of
every posting and the greatest of each list, and answers all items on it. No text is shuffled and no list is gathered: a
term that all documents hold is a list in each shard.

For an item a shard's lists are taken from the greatest maximum down. The pivot is the list after which what the maxima of
the others add up to falls below the threshold, the k-th best score that the task has met: documents in none of the lists
up to the pivot can't reach it and are skipped unseen. Of the others those go whose sum so far and the maxima left stay
below it; the lists behind the pivot are searched for those that remain, and the bound is drawn tighter after each. A shard
whose maxima stay below the threshold is skipped whole. Documents that equal the threshold stay, so that ties are decided
by the key. What the shards' heaps hold is merged by item.

Items are answered in blocks of about `BLOCK` bytes of terms, one if they are few; an item is never divided. The first
pass is made for each block. Rows of one item id are one item with the terms of all of them (a null id is an id).

Null texts have no terms and count neither as documents nor for the average; repeated rows are separate documents, and
rows with a null key come last among equals. Items without terms, or whose terms no document holds, have no rows. Very long
texts are counted in parts of `PART` bytes. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.batches import map_batches, slices
from .common import Tables

#: Postings in a shard, bytes of terms in a block of items, bytes of a text that are counted at once.
SHARD, BLOCK, PART = 2_000_000, 4_000_000, 1 << 20
#: What ends a term: all of ASCII but digits and letters. Others, and all that isn't ASCII, belong to terms.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).replace(_UPPER.encode(), _LOWER.encode())


def terms_of(text: Column) -> Column:
    """The terms of a text, with repeats."""
    found = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), f"[{SEPARATORS}]+")
    return F.filter(found, lambda t: t != "")


def counts_of(text: bytes, ids: dict[bytes, int]) -> tuple[int, Counter]:
    """Number of terms of a text, and how often each known one stands in it, by id."""
    text, total, found, at = text.translate(_TABLE), 0, Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + PART) if len(text) - at > PART else -1
        words = (text if at == 0 and end < 0 else text[at : end if end >= 0 else len(text)]).split()
        total += len(words)
        found.update(map(ids.get, words))
        at = end if end >= 0 else len(text)
    found.pop(None, None)
    return total, found


def _postings(docs: DataFrame, key: str, text: str, ids: dict[bytes, int]) -> DataFrame:
    """For each row the key, n, and the known terms that it holds with their counts."""

    def run(batches):
        for b in slices(batches):
            ns, ends, terms, tfs = [], [0], [], []
            for x in b.column(1).cast(pa.binary()).to_pylist():
                n, found = counts_of(x or b"", ids)
                ns.append(n)
                terms += found.keys()
                tfs += found.values()
                ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, tfs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), *lists], names=["key", "n", "terms", "tfs"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run, f"key {kind}, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Lists of a shard's postings by term; documents are numbered in order of their keys."""

    def __init__(self, table: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int):
        order = pc.sort_indices(table, sort_keys=[("key", "ascending")], null_placement="at_end")
        table = table.take(order).combine_chunks()
        self.keys, self.size = table.column("key"), table.num_rows
        terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        terms, tfs = (x.flatten().to_numpy(zero_copy_only=False) for x in (terms, tfs))
        lengths = [10 + (90 * n * n_docs) // n_terms for n in table.column("n").to_pylist()]  # whole numbers of any size
        docs = np.repeat(np.arange(self.size, dtype=np.int32), sizes)
        tfs, lengths = tfs.astype(np.int64), np.array([min(m, 1 << 59) for m in lengths], dtype=np.int64)
        impacts = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * lengths[docs]))
        by_term = np.argsort(terms, kind="stable")
        by_term = by_term[impacts[by_term] > 0]
        self._docs, self._impacts = docs[by_term], impacts[by_term]
        self._starts = np.zeros(len(weights) + 1, np.int64)
        np.cumsum(np.bincount(terms[by_term], minlength=len(weights)), out=self._starts[1:])
        self._tops = np.zeros(len(weights), np.int64)
        if len(by_term):
            held = np.flatnonzero(np.diff(self._starts))
            self._tops[held] = np.maximum.reduceat(self._impacts, self._starts[held])
        self._sums = np.zeros(self.size, np.int64)

    def _list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self._starts[term], self._starts[term + 1])
        return self._docs[part], self._impacts[part]

    def best(self, terms: np.ndarray, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to k documents (numbers and scores, best first) with scores above 0 and not below the threshold."""
        terms = terms[self._tops[terms] > 0]
        terms = terms[np.argsort(-self._tops[terms], kind="stable")]
        left = np.cumsum(self._tops[terms][::-1])[::-1].tolist() + [0]  # what the maxima from each list on add up to
        if not len(terms) or left[0] < threshold:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sums, pivot, look = self._sums, 0, 1
        sums[:] = 0
        while pivot < len(terms) and left[pivot] >= max(threshold, 1):
            docs, impacts = self._list(terms[pivot])
            sums[docs] += impacts
            pivot += 1
            if pivot == look:  # the k-th best sum so far is a threshold as well
                look *= 2
                threshold = max(threshold, _kth(sums, k))
        found = np.flatnonzero(sums >= max(1, threshold - left[pivot])).astype(np.int32)
        scores = sums[found]
        for i in range(pivot, len(terms)):
            threshold = max(threshold, _kth(scores, k))
            stays = scores + left[i] >= threshold
            if not stays.all():
                found, scores = found[stays], scores[stays]
            docs, impacts = self._list(terms[i])
            at = np.searchsorted(docs, found)
            at[at == len(docs)] = 0
            scores = scores + np.where(docs[at] == found, impacts[at], 0)
        stays = scores >= max(threshold, _kth(scores, k))
        found, scores = found[stays], scores[stays]
        first = np.lexsort((found, -scores))[:k]
        return found[first], scores[first]


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th greatest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[-k]) if len(scores) >= k else 0


def _shards(batches):
    """Tables of rows with up to SHARD postings in all."""
    held, size = [], 0
    for b in (b for b in batches if b.num_rows):
        held.append(b)
        size += len(b.column(2).flatten()) + b.num_rows
        if size >= SHARD:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _answers(postings: DataFrame, items: list, kind, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Item, key and score of what the heaps of the shards hold."""
    names, terms, arrow = [i for i, _ in items], [t for _, t in items], to_arrow_type(kind)

    def run(batches):
        heaps = [np.zeros(0, np.int64)] * len(terms)
        for table in _shards(batches):
            shard, found, scores, sizes = Shard(table, weights, n_docs, n_terms), [], [], []
            for i, wanted in enumerate(terms):
                docs, values = shard.best(wanted, k, int(heaps[i].min()) if len(heaps[i]) == k else 0)
                heaps[i] = np.sort(np.concatenate([heaps[i], values]))[-k:]
                found.append(docs)
                scores.append(values)
                sizes.append(len(docs))
            whose = np.repeat(np.arange(len(terms)), sizes)
            if len(whose):
                keys = shard.keys.take(pa.array(np.concatenate(found))).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(names, arrow).take(pa.array(whose)), keys, pa.array(np.concatenate(scores), pa.int64())], names=["item", "key", "score"])

    return map_batches(postings, run, f"item {kind.simpleString()}, key {postings.schema['key'].dataType.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each item, as (item, rank, key, score); ranks start at 1, equal scores come by ascending key."""
    spark, kind = docs.sparkSession, items.schema[item].dataType
    asked = items.select(F.col(item).alias("item"), F.explode(terms_of(F.col(item_text))).alias("term")).distinct()
    size = asked.agg(F.sum(F.length("term") + 16)).first()[0] or 0
    blocks, tables, parts = max(1, -(-size // BLOCK)), Tables(spark), []
    asked = asked.withColumn("block", F.expr(f"pmod(xxhash64(item), {blocks})"))
    if blocks > 1:
        asked = tables.keep(asked)
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).groupBy("item").agg(F.collect_list("term").alias("terms")).collect()  # of bounded size: a block
        ids = {t.encode(): i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
        postings = tables.keep(_postings(docs, key, text, ids))
        totals = postings.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        weights = np.zeros(len(ids), np.int64)
        for term, df in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row for each term of the block
            weights[term] = weight(totals["docs"], df)
        listed = [(r["item"], np.array([ids[t.encode()] for t in r["terms"]], dtype=np.int64)) for r in rows]
        parts.append(_answers(postings, listed, kind, weights, totals["docs"], max(1, totals["terms"]), k))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


#: The same by scoring every pair of an item and a document that share a term.
SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                      regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^{SEPARATORS}]+') AS words FROM documents),
         i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^{SEPARATORS}]+')) AS term FROM benchmark),
         c AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(words)) AS BIGINT) AS nt FROM d WHERE len(words) > 0),
         p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d)
               WHERE term IN (SELECT term FROM i) GROUP BY r, doc_id, n, term),
         w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT nd FROM c) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p GROUP BY term),
         s AS (SELECT i.item_id, p.r, p.doc_id,
                      CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * c.nd) // c.nt)))) AS BIGINT) AS score
               FROM i JOIN w USING (term) JOIN p USING (term) CROSS JOIN c GROUP BY i.item_id, p.r, p.doc_id),
         k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
