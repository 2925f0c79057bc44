"""Vector best-fit packing of documents' tokens into sequences.

A piece is a vector of tokens, documents (one) and attention cost (the square of its tokens); a sequence is what its
capacities of each have left. Pieces are taken from the longest down, and each goes to the open sequence that best fits
it, under every constraint: the least weighted norm of what is left after it (`rule="norm"`), or the greatest weighted dot
product of the piece and what is left before it (`rule="dot"`, which evens sequences out); if none fits, to a new one.

A piece's vector follows from its length, so that pieces of one length are alike, and sequences with the same left are
alike too. The plan is therefore made from the number of pieces of each length, at most as many figures as a sequence holds
tokens, whatever the size of the corpus, and says which ranks among the pieces of a length go to which sequences, in runs.
It is one plan for the whole corpus: nothing is lost at the rims of shards. Pieces get their ranks in buckets of about
`BUCKET` of a length by a running sum, and look up their places.

Rows that are alike in all columns are one row with a number until they are placed, so that repeated keys don't gather.
Null and empty texts are one end token; texts of any length are encoded in parts of about a megabyte; extra columns of the
documents are ignored, and those of pieces are carried on. An empty table gives no rows. Rows with a null key are packed.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.batches import map_batches, slices
from .bpe_codec import byte_characters
from .common import Tables, schema_of
from .edit_counts import pieces as cut

#: Tokens of a sequence, the token that ends a document, pieces of a length in a bucket, rows of a batch that leaves Python.
TOKENS, END, BUCKET, ROWS = 1024, 2, 16_384, 10_000
#: Weights of tokens, documents and attention cost in the norm and in the product.
WEIGHTS = (1.0, 0.01, 0.01)
_ODD = re.compile(r"[^\n\x20-\x7e\xa1-\u024f]")


class Encoder:
    """Ids of texts as the tokenizers library gives them, as little-endian unsigned 32-bit numbers.

    With a byte-level file no pre-token crosses a place where a space or line break follows what isn't white space, so
    that texts are cut there. Parts are encoded with the file's own vocabulary by a faster library of the same merges where
    both must agree: all characters have the same classes, by which pre-tokens are told, in all versions of Unicode, and
    white space is single spaces and line breaks, for which the pattern needs no look ahead (`_ODD` finds other parts).
    Other parts, other files, and texts in which a special token stands are left to the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        split = spec["pre_tokenizer"] or {}
        cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and spec["normalizer"] is None
        self._special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        self._fast = self._same_merges(spec) if cuts else None

    @staticmethod
    def _same_merges(spec: dict):
        """The vocabulary as ranks, if its ids are in the order of its merges; else None."""
        import tiktoken

        byte_of = {c: b for b, c in enumerate(byte_characters())}
        special = {x["content"] for x in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = [vocab.get(a + b) for a, b in merges]
        if None in ids or ids != sorted(ids) or len(ids) + len(byte_of) != len(vocab) or not all(c in byte_of for t in vocab for c in t):
            return None
        return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""), mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in vocab.items()}, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not self._fast or self._special.search(text):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out = []
        for part in cut(text, 1 << 20):
            if _ODD.search(part) or any(two in part for two in ("  ", " \n", "\n ", "\n\n")):
                out += (np.array(e.ids, dtype="<u4").tobytes() for e in self._library.encode_batch_fast(cut(part, 1 << 12), add_special_tokens=False))
            else:
                out.append(np.array(self._fast.encode_ordinary(part), dtype="<u4").tobytes())
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bounds(n: int, most: int) -> list[int]:
    """Where n tokens are cut into pieces of `most`, of which the first may be shorter."""
    return [0, *range(n % most or most, n + 1, most)] if n else [0]


def pieces(docs: DataFrame, path: str, most: int = TOKENS, end: int | None = END, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The key, piece (from 0), start, length and ids_crc32 of each piece, and its ids if they are asked for."""
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    arrow, last = to_arrow_schema(schema_of(ddl)), b"" if end is None else np.array([end], dtype="<u4").tobytes()

    def run(batches):
        for b in slices(batches):
            whose, rows, taken = [], [], []
            for i, x in enumerate(b.column(1)):
                ids = memoryview(encoder(path).encode(x.as_py() or "") + last)
                for n, (low, high) in enumerate(pairwise(bounds(len(ids) // 4, most))):
                    part = ids[4 * low : 4 * high]
                    whose.append(i)
                    rows.append((n, low, high - low, zlib.crc32(part)))
                    if with_ids:
                        taken.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [pa.array([r[i] for r in rows], arrow.field(i + 1).type) for i in range(4)]
            if with_ids:
                columns.append(pa.array(taken, arrow.field(5).type))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(whose, pa.int64())), *columns], schema=arrow)

    return map_batches(docs.select(F.col(key), F.col(text).cast("string").alias("text")), run, ddl)


class Plan:
    """Where pieces go, by length and rank among the pieces of that length, from the number of pieces of each length.

    Run i holds ranks of a length from first[i] on: `per` pieces in each sequence from `sequence` on, from offset `at`.
    """

    def __init__(self, counts: dict[int, int], tokens: int = TOKENS, documents: int | None = None, cost: int | None = None, weights=WEIGHTS, rule: str = "norm"):
        if rule not in ("norm", "dot"):
            raise ValueError("rule is norm or dot")
        # as many documents as tokens, and the cost of one document of all of them, always fit
        self._caps, self._weights, self._rule = np.array([tokens, documents or tokens, cost or tokens * tokens], dtype=np.int64), np.array(weights, dtype=float), rule
        self._left, self._ranges, self._open, self.sequences = np.zeros((64, 3), np.int64), [], 0, 0
        self._least, runs = min(counts, default=0), []
        for length in sorted(counts, reverse=True):
            vector = np.array([length, 1, length * length], dtype=np.int64)
            if length < 1 or (vector > self._caps).any():
                raise ValueError(f"no sequence can hold a piece of {length} tokens")
            runs += [(length, *r) for r in self._place(vector, counts[length])]
        runs.sort()
        self.lengths, self._first, self._sequence, self._per, self._at = (np.array([r[i] for r in runs], dtype=np.int64) for i in range(5))
        sizes = np.array([counts[n] for n in sorted(counts)], dtype=np.int64)
        self._known, self._before = np.array(sorted(counts), dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if counts else np.zeros(0, np.int64)
        self._keys = self._first + self._before[np.searchsorted(self._known, self.lengths)]

    def _put(self, left: np.ndarray, ranges: list[tuple[int, int]]) -> None:
        """Opens sequences (ranges of numbers) with so much left, unless nothing more fits in them."""
        if left[0] < self._least or left[1] < 1 or left[2] < self._least**2:
            return
        alike = np.flatnonzero((self._left[: self._open] == left).all(axis=1))
        if len(alike):
            self._ranges[alike[0]] += ranges
            return
        if self._open == len(self._left):
            self._left = np.concatenate([self._left, np.zeros_like(self._left)])
        self._left[self._open] = left
        self._ranges.append(ranges)
        self._open += 1

    def _close(self, i: int) -> None:
        self._open -= 1
        self._left[i] = self._left[self._open]
        last = self._ranges.pop()
        if i < self._open:
            self._ranges[i] = last

    def _best(self, vector: np.ndarray) -> int | None:
        """The kind of open sequences that fits the vector best; of equals the one with least tokens, documents and cost left."""
        left = self._left[: self._open]
        fits = np.flatnonzero((left >= vector).all(axis=1))
        if not len(fits):
            return None
        if self._rule == "norm":
            score = (self._weights * ((left[fits] - vector) / self._caps) ** 2).sum(axis=1)
        else:
            score = -(self._weights * (left[fits] / self._caps) * (vector / self._caps)).sum(axis=1)
        return int(fits[np.lexsort((*left[fits].T[::-1], score))[0]])

    def _place(self, vector: np.ndarray, count: int):
        """Runs (first, sequence, per, at) of so many pieces of one vector."""
        done = 0
        while done < count:
            best = self._best(vector)
            if best is None:
                left, per = self._caps, int((self._caps // vector).min())
                ranges = [(self.sequences, -(-(count - done) // per))]
                self.sequences += ranges[0][1]
            else:
                left, per, ranges = self._left[best].copy(), int((self._left[best] // vector).min()), self._ranges[best]
                self._close(best)
            while ranges and done < count:
                start, n = ranges.pop()
                whole = min(n, (count - done) // per)
                if whole:
                    yield done, start, per, int(self._caps[0] - left[0])
                    done += whole * per
                    self._put(left - per * vector, [(start, whole)])
                if whole < n and done < count:  # fewer are left than fit in one
                    rest = count - done
                    yield done, start + whole, rest, int(self._caps[0] - left[0])
                    done += rest
                    self._put(left - rest * vector, [(start + whole, 1)])
                    whole += 1
                if whole < n:
                    ranges.append((start + whole, n - whole))
            if ranges:
                self._put(left, ranges)

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of pieces."""
        run = np.searchsorted(self._keys, self._before[np.searchsorted(self._known, lengths)] + ranks, side="right") - 1
        beyond = ranks - self._first[run]
        return self._sequence[run] + beyond // self._per[run], self._at[run] + beyond % self._per[run] * lengths


def pack(parts: DataFrame, tokens: int = TOKENS, documents: int | None = None, cost: int | None = None, weights=WEIGHTS, rule: str = "norm", length: str = "length") -> DataFrame:
    """The rows of parts with sequence_id (from 0, gapless) and offset (its place there, gapless from 0).

    tokens, documents and cost are what a sequence holds at most; without the last two only tokens bind. A piece that no
    sequence can hold, or with a null length or one below 1, is an error.
    """
    if {"sequence_id", "offset"} & {*parts.columns}:
        raise ValueError("sequence_id and offset are added, and can't be columns of the pieces")
    parts = Tables(parts.sparkSession).keep(parts)  # encoded once
    counts = {r["n"]: r["count"] for r in parts.groupBy(F.col(length).cast("long").alias("n")).count().collect()}  # a row for each length
    if None in counts:
        raise ValueError("a piece has no length")
    plan = Plan(counts, tokens, documents, cost, weights, rule)
    names, columns = parts.columns, [F.col(c) for c in parts.columns]
    dealt = parts.sparkSession.createDataFrame([(n, -(-c // BUCKET)) for n, c in counts.items()], "_size long, _buckets long")
    grouped = parts.groupBy(*names).agg(F.count("*").alias("_copies")).withColumn("_size", F.col(length).cast("long"))
    grouped = grouped.join(F.broadcast(dealt), "_size").withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.col("_buckets")))
    sums = grouped.groupBy("_size", "_bucket").agg(F.sum("_copies").alias("_sum"))
    running = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_size", "_bucket", F.coalesce(F.sum("_sum").over(running(Window.partitionBy("_size").orderBy("_bucket"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_copies").over(running(Window.partitionBy("_size", "_bucket").orderBy(*columns))), F.lit(0))
    ranked = grouped.withColumn("_inside", inside).join(before, ["_size", "_bucket"]).select(*names, "_copies", "_size", (F.col("_before") + F.col("_inside")).alias("_rank"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)

    def run(batches):
        for b in batches:
            copies, sizes, ranks = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(names), len(names) + 3))
            ends = np.cumsum(copies)
            for low in range(0, int(ends[-1]) if len(ends) else 0, ROWS):
                place = np.arange(low, min(low + ROWS, ends[-1]))
                row = np.searchsorted(ends, place, side="right")
                sequence, offset = plan.places(sizes[row], ranks[row] + place - (ends[row] - copies[row]))
                taken = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(taken) for i in range(len(names))), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return map_batches(ranked, run, f"{kept}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from packed pieces with their ids."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))  # at most as many as a sequence holds
    return held.select("sequence_id", F.flatten(F.col("held.ids")).alias("ids"))
