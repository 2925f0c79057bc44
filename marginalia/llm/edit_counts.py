"""Token counts that follow edits.

A document is cut where a space or line break follows what is not white space: no pre-token crosses such a place, so that
the counts of the pieces, which are pre-tokens or a word with its marks, add up. They are the leaves of a segment tree of
characters and tokens. An edit re-encodes only the leaves that it touches, and neighbours while the place where they meet
is no longer such a cut; sums change along the paths to the root, and where an edit needs more leaves than it touched,
the leaves move and sums are made again, without encoding. Several edits of a document go in one pass from the left, after
which sums are made once, so that they take time in proportion to the text and to what they encode.

`trees` gives the trees of documents as rows to be kept, and `edited` applies edits to kept ones, so that a document is
encoded once. `count_edited` does both at once for edits that follow from the text.

The vocabulary is a `tiktoken` rank file with its pattern. Null and empty texts count 0. Edits are (start, end, text) in
code points of the text as it was, not overlapping, in any order; they are applied from the last to the first, and of
those at one place that of the greatest end first. Whole texts are counted, however long; repeated rows are counted
alike; other columns are ignored. Rows with a null key have no edits.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.batches import map_batches, slices
from . import common

#: Pieces in each of two generations of counts that a worker keeps, and characters up to which a leaf's count is kept.
KEPT, LEAF = 300_000, 48
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: What the default edits blank out: mail and IPv4 addresses.
_PRIVATE = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")


@lru_cache(maxsize=1)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Tokens of pieces; those of short ones are remembered, as words come again."""

    def __init__(self, encode: Callable[[str], int]):
        self._encode, self._young, self._old = encode, {}, {}

    def _new(self, piece: str) -> int:
        if (n := self._old.get(piece)) is None:
            n = self._encode(piece) if piece else 0
        if len(piece) <= LEAF:
            if len(self._young) >= KEPT:
                self._old, self._young = self._young, {}
            self._young[piece] = n
        return n

    def each(self, parts: list[str]) -> list[int]:
        young, new = self._young.get, self._new
        return [n if (n := young(p)) is not None else new(p) for p in parts]


@lru_cache(maxsize=1)
def counter(path: str, pattern: str) -> Counter:
    known = encoding(path, pattern)
    return Counter(lambda s: len(known.encode_ordinary(s)))


def pieces(text: str, size: int = 1) -> list[str]:
    """The text in its pieces; with a size in parts of so many characters and up to the first cut after them."""
    if size <= 1:
        return _CUT.split(text) if text else []
    out, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + size) if len(text) - at > size else None
        out.append(text[at : (at := cut.start() if cut else len(text))])
    return out


class CountTree:
    """Segment tree over pieces of a text; each node has the characters and tokens below it."""

    def __init__(self, text: str, count: Callable[[str], int] | Counter, size: int = 1, kept: tuple[np.ndarray, np.ndarray] | None = None):
        """kept: the tree's arrays of characters and tokens, if it isn't new."""
        self._counter, self._size, self._text, self.encoded = count if isinstance(count, Counter) else Counter(count), size, text, 0
        if kept is None:
            self._build(*self._counted(text))
        else:
            self.chars, self.sums = (np.array(x, dtype=np.int64) for x in kept)
            self._n = len(self.chars) // 2

    def _counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the pieces of a text."""
        parts = pieces(text, self._size)
        self.encoded += len(text)
        return np.fromiter(map(len, parts), np.int64, len(parts)), np.array(self._counter.each(parts), dtype=np.int64)

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        n = 1 << max(0, len(chars) - 1).bit_length()
        self._n, arrays = n, []
        for leaves in (chars, tokens):
            tree = np.zeros(2 * n, np.int64)
            tree[n : n + len(leaves)] = leaves
            level = n
            while level > 1:
                tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(axis=1)
                level //= 2
            arrays.append(tree)
        self.chars, self.sums = arrays

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        i = self._n + leaf
        self.chars[i], self.sums[i] = chars, tokens
        while i := i // 2:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def tokens(self) -> int:
        return int(self.sums[1])

    @property
    def text(self) -> str:
        return self._text

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character (the last that has any, at the end), and where it starts."""
        i, start = 1, 0
        at = min(at, max(0, int(self.chars[1]) - 1))
        while i < self._n:
            i *= 2
            if at - start >= self.chars[i]:
                start += int(self.chars[i])
                i += 1
        return i - self._n, start

    def _beside(self, leaf: int, step: int) -> int | None:
        """The next leaf on a side that has any characters."""
        leaf += step
        while 0 <= leaf < self._n and not self.chars[self._n + leaf]:
            leaf += step
        return leaf if 0 <= leaf < self._n else None

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts new in place of the characters from start to end."""
        whole = int(self.chars[1])
        old, self._text = self._text, self._text[:start] + new + self._text[end:]
        if not whole:
            return self._build(*self._counted(self._text))
        a, low = self._leaf(start)
        b, high = self._leaf(max(start, end - 1))
        high += int(self.chars[self._n + b])
        region = old[low:start] + new + old[end:high]
        while (left := self._beside(a, -1)) is not None and region[:1] not in (" ", "\n"):
            a, size = left, int(self.chars[self._n + left])
            region, low = old[low - size : low] + region, low - size
        while (right := self._beside(b, 1)) is not None and (not region or region[-1].isspace()):
            b, size = right, int(self.chars[self._n + right])
            region, high = region + old[high : high + size], high + size
        chars, tokens = self._counted(region)
        if len(chars) > b - a + 1:
            n = self._n
            join = lambda tree, part: np.concatenate([tree[n : n + a], part, tree[n + b + 1 :]])
            joined = join(self.chars, chars), join(self.sums, tokens)
            filled = joined[0] > 0
            return self._build(joined[0][filled], joined[1][filled])
        for i in range(b - a + 1):
            self._set(a + i, *((int(chars[i]), int(tokens[i])) if i < len(chars) else (0, 0)))
        return None

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """All edits of the text as it is, in one pass from the left, in time of the text and of what they encode."""
        todo, old = sorted(edits), self._text
        apart = all(a[1] <= b[0] for a, b in zip(todo, todo[1:], strict=False))
        if len(todo) < 2 or not self.chars[1] or not apart or not all(0 <= s <= e <= len(old) for s, e, _ in todo):
            for edit in reversed(todo):
                self.replace(*edit)
            return
        sizes, sums = self.chars[self._n :], self.sums[self._n :]
        held = np.flatnonzero(sizes)
        sizes, sums = sizes[held], sums[held]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        last = len(sizes) - 1
        leaf = lambda at: min(int(np.searchsorted(begins, at, "right")) - 1, last)
        regions, i = [], 0  # first leaf, leaf after the last, parts of the text in their place
        while i < len(todo):
            a = b = leaf(todo[i][0])
            parts, at = [], int(begins[a])
            while i < len(todo) and (a == b or leaf(todo[i][0]) < b):
                start, end, new = todo[i]
                b, i = max(b, leaf(max(start, end - 1)) + 1), i + 1
                parts += [p for p in (old[at:start], new) if p]
                at = end
                shown = old[begins[b] - 1] if at < begins[b] else parts[-1][-1] if parts else ""
                if shown.isspace() and b <= last:  # it must end at a cut
                    b += 1
            parts += [p for p in (old[at : begins[b]],) if p]
            while parts and parts[0][0] not in (" ", "\n") and a:  # and begin at one
                if regions and regions[-1][1] == a:
                    a, _, before = regions.pop()
                    before += parts
                    parts = before
                else:
                    a -= 1
                    parts.insert(0, old[begins[a] : begins[a + 1]])
            regions.append((a, b, parts))
        chars, tokens, text, done = [], [], [], 0
        for a, b, parts in regions:
            counted = self._counted("".join(parts))
            chars += [sizes[done:a], counted[0]]
            tokens += [sums[done:a], counted[1]]
            text += [old[begins[done] : begins[a]], *parts]
            done = b
        self._text = "".join([*text, old[begins[done] :]])
        self._build(np.concatenate([*chars, sizes[done:]]), np.concatenate([*tokens, sums[done:]]))


def private_edits(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "[removed]") for m in _PRIVATE.finditer(text)]


def trees(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, and the tree's arrays of characters and tokens, the root at 1 and the nodes below i at 2i and 2i + 1."""

    def kernel(texts):
        made = [CountTree(t, counter(path, pattern)) for t in texts]
        return [[t.tokens for t in made], [t.chars for t in made], [t.sums for t in made]]

    return common.map_texts(df, kernel, "n_tokens long, chars array<long>, sums array<long>", key, text)


def edited(kept: DataFrame, df: DataFrame, edits: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of trees after edits (key, start, end, new), with the text after them and the characters that were encoded for that.

    A key has one row in kept and one in df.
    """
    listed = edits.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", F.coalesce("new", F.lit("")).alias("new")))).alias("edits"))
    rows = df.select(key, F.col(text).cast("string").alias("text")).join(kept.select(key, "chars", "sums"), key).join(listed, key, "left").select(key, "text", "chars", "sums", "edits")

    def run(batches):
        for b in slices(batches):
            out = []
            for t, chars, sums, todo in zip(*(b.column(i) for i in range(1, 5)), strict=True):
                tree = CountTree(t.as_py() or "", counter(path, pattern), kept=(chars.values.to_numpy(), sums.values.to_numpy()))
                tree.apply([(e["start"], e["end"], e["new"]) for e in todo.as_py() or []])
                out.append((tree.tokens, tree.chars, tree.sums, tree.text, tree.encoded))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=[key, "n_tokens", "chars", "sums", "text", "n_encoded_again"])

    kind = df.schema[key].dataType.simpleString()
    return map_batches(rows, run, f"`{key}` {kind}, n_tokens long, chars array<long>, sums array<long>, text string, n_encoded_again long")


def count_edited(df: DataFrame, path: str, pattern: str, edits: Callable[[str], list[tuple[int, int, str]]] = private_edits, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, tokens before and after the edits, number of edits, characters, and characters encoded anew for the edits."""

    def kernel(texts):
        rows = []
        for t in texts:
            tree = CountTree(t, counter(path, pattern))
            before, first = tree.tokens, tree.encoded
            tree.apply(todo := edits(t))
            rows.append((before, tree.tokens, len(todo), len(t), tree.encoded - first))
        return [[r[i] for r in rows] for i in range(5)]

    return common.map_texts(df, kernel, "n_tokens long, n_tokens_after long, n_edits long, n_chars long, n_encoded_again long", key, text)
