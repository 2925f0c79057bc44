"""Removal of repeated strings of bytes by interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller key. The transform
finds all that repeats; what comes before it only brings together what may be equal:

1. Anchors. Of the codes of the `ANCHOR`-byte strings inside a `LENGTH`-byte string the least is its anchor, so that
   equal strings have the same one. Strings in a row with one anchor are a fragment. Codes meet by value, packed; per
   slice of documents only the least and greatest document of a code go there.
2. Documents whose anchors others share are joined with these and make the fragments again, now with text. Fragments of
   a slice that share an anchor with others of it (`FEW` or more) form a text; its transform tells which of their strings a
   smaller document of the slice holds. Fragments that are wholly removed so are not sent on: a passage in a third of all
   documents is one row for each slice.
3. Fragments meet by anchor, packed again, and form texts of whole anchors of up to `INDEX` bytes. Of equal fragments those
   of the two least documents come into a text and stand for their copies. A larger anchor is halved, and what is left of both halves compared in pairs of blocks. Anchors of more than `HOT` rows are first dealt
   out with a salt, and only what is left of them meets in a second turn.
4. Spans are merged for each document, and the text without them is formed.

A text's suffixes are sorted and the transform's boundaries extended backwards in breadth, which sets longest common
prefixes by increasing value, from those below 8 that words of 8 bytes tell, and stops at `LENGTH`. What is still joined then are equal strings; their least document
decides.

All documents are read whole, as UTF-8. Null and empty texts and texts below `LENGTH` bytes lose nothing. Keys are
integers. Rows that repeat a key and text are returned alike; different texts of one key are parts of one document, which
remove nothing from each other. Rows with a null key neither remove nor lose anything. Matches never cross texts.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.batches import map_batches, slices
from .common import Tables, tasks_of
from .shingles import mix

LENGTH, ANCHOR = 50, 20
#: Bytes of documents that are scanned at once, and of fragments in one transform.
SCAN, INDEX = 2_000_000, 500_000
#: Places whose codes are made at once, so that they stay in the processor's cache.
CACHED = 65_536
#: Fragments of an anchor in a slice below which they are sent on as they are.
FEW = 4
#: Rows of an anchor (one or two for each slice of documents that holds it) up to which one task takes it at once.
HOT = 20_000
#: Bytes of documents for a task, and how many parts, one after the other, a task has.
TASK, PARTS = 16_000_000, 4
_CODE_BITS = 48

_ODD = np.uint64(0x9E3779B97F4A7C15)


def codes(data: np.ndarray, size: int) -> np.ndarray:
    """A code of the `size` bytes from each place (16 to 24); data has 32 more bytes than places."""
    n = len(data) - 32
    eight = np.lib.stride_tricks.as_strided(data, (n + 24, 8), (1, 1)).copy().view(np.uint64).reshape(-1)
    out = eight[:n] * _ODD
    out ^= out >> np.uint64(32)
    out += eight[8 : n + 8]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out += eight[size - 8 : n + size - 8]
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return out


def _least_codes(data: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """The least code of the `length` bytes from each place; data has 32 bytes more than the texts."""
    low, window, have = codes(data, anchor), length - anchor + 1, 1
    while 2 * have <= window:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < window:
        low = np.minimum(low[: have - window], low[window - have :])
    return low[: len(data) - 32 - length + 1]


def fragments(texts: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor code, number of the text, first place and number of strings of each fragment of texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(32), dtype=np.uint8)
    n = len(data) - 32
    empty = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if n < length:
        return empty
    low = np.concatenate([_least_codes(data[at : at + CACHED + length - 1 + 32], length, anchor) for at in range(0, n - length + 1, CACHED)])
    begins = np.cumsum(sizes) - sizes
    change = np.ones(len(low), bool)
    change[1:] = low[1:] != low[:-1]
    change[begins[begins < len(low)]] = True
    at = np.flatnonzero(change)
    run = np.diff(np.append(at, len(low)))
    text = np.searchsorted(begins, at, side="right") - 1
    run = np.minimum(run, np.maximum(0, begins[text] + sizes[text] - length + 1 - at))
    keep = run > 0
    return low[at[keep]], text[keep], (at - begins[text])[keep], run[keep]


def pack(columns: list[np.ndarray]) -> bytes:
    """Integers of columns of one length, by planes of bytes, compressed."""
    out = [np.int64(len(columns[0])).tobytes()]
    for c in columns:
        low = int(c.min()) if len(c) else 0
        planes = np.ascontiguousarray((c - low).astype("<u8")).view(np.uint8).reshape(-1, 8).T
        out += [np.int64(low).tobytes(), planes.tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8
    while at < len(raw):
        low = np.frombuffer(raw, np.int64, 1, at)[0]
        planes = np.frombuffer(raw, np.uint8, 8 * n, at + 8).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view("<i8").reshape(-1) + low)
        at += 8 + 8 * n
    return out


def short(code: np.ndarray) -> np.ndarray:
    """48 bits of a code: few enough to send, enough to tell anchors apart (two that meet cost work, not results)."""
    return (mix(code) >> np.uint64(16)).astype(np.int64)


def _dealt(part: np.ndarray):
    """Rows of each part: (part, their numbers)."""
    order = np.argsort(part, kind="stable")
    edges = [*np.flatnonzero(np.diff(part[order], prepend=-1)), len(order)]
    for a, b in itertools.pairwise(edges):
        yield int(part[order[a]]), order[a:b]


def _scans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together or cut to about `SCAN` bytes of text: what a slice holds twice needs to leave it but once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in slices(batches, 2, SCAN):
        if held and size + b.nbytes > SCAN:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def _anchored(length: int, anchor: int, parts: int):
    """Rows (part, packed code, doc and whether it is known to be shared) of each slice's fragments."""

    def run(batches):
        for b in _scans(batches):
            docs = b.column(0).to_numpy()
            code, text, _, _ = fragments(_bytes(b.column(2)), length, anchor)
            if not len(code):
                continue
            code, doc = short(code), docs[text]
            order = np.lexsort((doc, code))
            code, doc = code[order], doc[order]
            once = np.ones(len(code), bool)
            once[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
            code, doc = code[once], doc[once]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            last = np.append(first[1:], len(code)) - 1
            known = np.repeat(doc[first] != doc[last], last - first + 1)
            sent = np.zeros(len(code), bool)
            sent[first] = sent[last] = True
            # what is known and not sent to be found out for others may go anywhere
            part = np.where(known & ~sent, mix(doc.astype(np.uint64)).astype(np.int64) & ((1 << 40) - 1), code) % parts
            flag = known.astype(np.int64) + (known & ~sent)
            rows = [(p, pack([code[r], doc[r], flag[r]])) for p, r in _dealt(part)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "packed"])

    return run


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _parts(batches, columns: int) -> Iterator[tuple[int, list[tuple]]]:
    """Each part's rows (without the part), of batches that are sorted by it."""
    part, rows = None, []
    for b in slices(batches, columns):
        for p, *row in zip(*(b.column(i).to_pylist() for i in range(columns + 1)), strict=True):
            if p != part and rows:
                yield part, rows
                rows = []
            part = p
            rows.append(tuple(row))
    if rows:
        yield part, rows


def _shared(hot: int):
    """Of parts that hold all rows of their codes: (doc, code) of codes in two documents or more; above a code, its salts."""

    def run(batches):
        for _, rows in _parts(batches, 1):
            code, doc, flag = (np.concatenate(c) for c in zip(*(unpack(x) for (x,) in rows), strict=True))
            shared, salts = flag > 0, np.ones(len(code), np.int64)
            meet = np.flatnonzero(flag < 2)
            order = meet[np.argsort(code[meet], kind="stable")]
            sorted_code, sorted_doc = code[order], doc[order]
            if len(order):
                first = np.flatnonzero(np.diff(sorted_code, prepend=-1))
                n = np.diff(np.append(first, len(order)))
                many = np.minimum.reduceat(sorted_doc, first) != np.maximum.reduceat(sorted_doc, first)
                shared[order] |= np.repeat(many, n)
                salts[order] = np.repeat(np.minimum(1 + n // hot, (1 << 15) - 1), n)
            code = code | (salts << _CODE_BITS)
            for at in range(0, len(code), 200_000):
                rows = at + np.flatnonzero(shared[at : at + 200_000])
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(code[rows])], names=["doc", "code"])

    return run


class Pieces(NamedTuple):
    """Fragments: anchor, document, which text of it, first place, number of strings, first byte in a pool of bytes, salts."""

    code: np.ndarray
    doc: np.ndarray
    row: np.ndarray
    at: np.ndarray
    count: np.ndarray
    start: np.ndarray
    salts: np.ndarray

    def take(self, rows) -> Pieces:
        return Pieces(*(c[rows] for c in self))

    def bytes_of(self, pool: np.ndarray, length: int, mark: int = 0) -> np.ndarray:
        """The fragments' bytes one after the other, each with `mark` more bytes of 255 (which UTF-8 doesn't have)."""
        size = self.count + length - 1 + mark
        end = np.cumsum(size)
        index = np.arange(end[-1] if len(end) else 0) + np.repeat(self.start - (end - size), size)
        out = pool[np.minimum(index, len(pool) - 1)]
        if mark:
            out[end - 1] = 255
        return out


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of so many bits, and the keys in it. Key and number are sorted as one word where they fit into it."""
    own = np.uint64(len(key).bit_length())
    if bits + int(own) > 64:
        order = np.argsort(key)
        return order.astype(np.int32), key[order]
    word = (key << own) | np.arange(len(key), dtype=np.uint64)
    word.sort()
    return (word & ((np.uint64(1) << own) - np.uint64(1))).astype(np.int32), word >> own


def suffix_order(data: np.ndarray, length: int) -> np.ndarray:
    """Places of data sorted by the `length` bytes from each, or more (beyond the end: zeros).

    The first key has as many bytes, numbered among those that occur, as fit with a place into a word. Then ranks are put
    together, two or three in a row; only rows that are still tied are sorted again.
    """
    n = len(data)
    bits = n.bit_length()
    used = np.bincount(data, minlength=256) > 0
    used[0] = True
    width = max(1, int(used.sum() - 1).bit_length())
    size = min(length, (64 - bits) // width)
    padded = np.zeros(n + size, np.uint64)
    padded[:n] = (np.cumsum(used) - 1)[data]
    key = padded[:n].copy()
    for i in range(1, size):
        key <<= np.uint64(width)
        key |= padded[i : n + i]
    order, key = _sorted(key, size * width)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 3 * length, np.int32)  # 0 beyond the end
    rows = np.arange(n, dtype=np.int32)
    rank[order] = own = np.maximum.accumulate(np.where(new, rows + 1, 0))
    while size < length:
        tied = ~(new & np.append(new[1:], True))
        rows, own = rows[tied], own[tied]
        if not len(rows):
            break
        joined = min(3, max(2, (64 - len(rows).bit_length()) // bits))
        place = order[rows]
        key = own.astype(np.uint64)
        for k in range(1, joined):
            key <<= np.uint64(bits)
            key |= rank[place + k * size].astype(np.uint64)
        by, key = _sorted(key, joined * bits)
        place = place[by]
        order[rows] = place
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        rank[place] = own = np.maximum.accumulate(np.where(new, rows + 1, 0))
        size *= joined
    return order


def joined_prefixes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and of each suffix whether its longest common prefix with the one before reaches `length`.

    data ends in a byte 0, which stands also between its strings. Boundaries between intervals of suffixes with a
    common prefix are found by increasing value: those of values below 8 divide first words of 8 bytes; one of value v makes
    one of value v+1 for each byte before, where the intervals' rows with that byte are divided (the map from rows to rows of
    the transform is LF). Rows that are divided at value `length` - 1 or before are boundaries. Where two rows with the same
    byte before are neighbours, only a boundary between them divides what LF makes of them, so that it just follows.
    """
    n, least = len(data), min(8, length)
    order = suffix_order(data, length)
    before = data[order - 1]  # the transform
    rows = np.argsort(before, kind="stable").astype(np.int32)  # LF maps rows[k] to k
    words = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]), (n, 8), (1, 1)).copy()
    words[:, least:] = 0
    words = words.view(np.uint64).reshape(-1)[order]
    divided = np.ones(n, bool)
    divided[1:] = words[1:] != words[:-1]
    # pairs of successive rows with the same byte before: (above, below) map to k-1 and k
    same = before[rows]
    k = (np.flatnonzero((same[1:] == same[:-1]) & ~divided[1:]) + 1).astype(np.int32)
    above, below = rows[k - 1], rows[k]
    beside = below == above + 1
    follows = np.full(n, -1, np.int32)
    follows[below[beside]] = k[beside]
    k, above, below = k[~beside], above[~beside], below[~beside]
    fresh = np.flatnonzero(divided).astype(np.int32)
    for _ in range(least, length):
        after = follows[fresh]
        after = after[after >= 0]
        seen = np.cumsum(divided, dtype=np.int32)
        now = seen[below] > seen[above]
        fresh = np.concatenate([k[now], after])
        if not len(fresh):
            break
        divided[fresh] = True
        rest = ~now
        k, above, below = k[rest], above[rest], below[rest]
    return order, ~divided


def least_before(data: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each place where one of the strings in data begins `length` bytes, the least document that holds these.

    The strings have `size` bytes, and each is followed by a byte 255.
    """
    order, joined = joined_prefixes(data + np.uint8(1), length)  # bytes shift by one, so that 0 is only a separator
    docs, number = np.unique(doc, return_inverse=True)
    begin = np.cumsum(size + 1) - (size + 1)
    until = np.repeat((begin + size - length).astype(np.int32), size + 1)  # the last place of a string of `length` bytes
    inside = np.arange(len(data), dtype=np.int32) <= until
    document = np.where(inside, np.repeat(number.astype(np.int32), size + 1), np.iinfo(np.int32).max)[order]
    first = np.flatnonzero(~joined)
    smallest = np.minimum.reduceat(document, first)
    out = np.empty(len(data), np.int32)
    out[order] = np.repeat(smallest, np.diff(np.append(first, len(data))))
    return docs[out[inside]]


def _least_before(texts: list[bytes], least: np.ndarray, length: int) -> list[np.ndarray]:
    """As least_before, by string."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    found = least_before(np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8), size, np.asarray(least), length)
    return np.split(found, np.cumsum(np.maximum(0, size - length + 1))[:-1])


def _blocks(p: Pieces, length: int, most: int) -> list[slice]:
    """Runs of fragments of up to `most` bytes (or one fragment)."""
    ends, out, at = np.cumsum(p.count + length), [], 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        out.append(slice(at, end))
        at = end
    return out


def hits(pool: np.ndarray, p: Pieces, length: int, most: int = INDEX) -> np.ndarray:
    """Of each string of fragments (sorted by document), whether a smaller document among them holds it."""
    total = int((p.count + length).sum())
    if total <= most or len(p.doc) < 2:
        size = p.count + length - 1
        return least_before(p.bytes_of(pool, length, 1), size, p.doc, length) < np.repeat(p.doc, p.count) if len(size) else np.zeros(0, bool)
    half = int(np.clip(np.searchsorted(np.cumsum(p.count + length), total // 2), 1, len(p.doc) - 1))
    a, b = p.take(slice(0, half)), p.take(slice(half, None))
    gone = hits(pool, a, length, most), hits(pool, b, length, most)
    left, right = a.take(~wholly(a, gone[0])), np.flatnonzero(~wholly(b, gone[1]))
    begin = np.cumsum(b.count) - b.count
    rest = b.take(right)
    for x in _blocks(left, length, most // 2):
        for y in _blocks(rest, length, most // 2):
            one, two = left.take(x), rest.take(y)
            found = hits(pool, Pieces(*(np.concatenate(c) for c in zip(one, two, strict=True))), length, total)
            n = two.count
            place = np.repeat(begin[right[y]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            gone[1][place] |= found[one.count.sum() :]
    return np.concatenate(gone)


def wholly(p: Pieces, gone: np.ndarray) -> np.ndarray:
    """Which fragments have only strings that are gone."""
    return np.logical_and.reduceat(gone, np.cumsum(p.count) - p.count) if len(p.count) else np.zeros(0, bool)


def copied(pool: np.ndarray, p: Pieces, length: int) -> np.ndarray:
    """The fragment that each one of p (sorted by anchor and document) is a copy of: of equal ones those of the two least documents stand for all."""
    edge = np.flatnonzero(np.diff(p.code, prepend=-1))
    n = np.diff(np.append(edge, len(p.code)))
    of = np.arange(len(p.code))
    rows = np.flatnonzero(np.repeat(n > 2, n))
    one: dict[bytes, int] = {}
    two: dict[bytes, int] = {}
    raw, docs = memoryview(np.ascontiguousarray(pool)), p.doc.tolist()
    for i, a, b in zip(rows.tolist(), p.start[rows].tolist(), (p.start + p.count + length - 1)[rows].tolist(), strict=True):
        text = bytes(raw[a:b])
        first = one.setdefault(text, i)
        of[i] = first if docs[first] == docs[i] else two.setdefault(text, i)
    return of


def decide(pool: np.ndarray, p: Pieces, length: int, most: int = INDEX) -> np.ndarray:
    """As hits, of fragments sorted by anchor and document: in texts of whole anchors, as no other fragments hold equal strings.

    Of equal fragments two come into a text, whose transform decides for their copies too: what it removes of the second,
    as the first document holds it, goes from all that follow.
    """
    of = copied(pool, p, length)
    own = np.flatnonzero(of == np.arange(len(of)))
    gone = _decide(pool, p.take(own), length, most)
    if len(own) == len(of):
        return gone
    begin = np.cumsum(p.count[own]) - p.count[own]
    place = begin[np.searchsorted(own, of)] - (np.cumsum(p.count) - p.count)
    return gone[np.repeat(place, p.count) + np.arange(p.count.sum())]


def _decide(pool: np.ndarray, p: Pieces, length: int, most: int) -> np.ndarray:
    edge = np.flatnonzero(np.diff(p.code, prepend=-1))
    sums = np.add.reduceat(p.count + length, edge) if len(edge) else np.zeros(0, np.int64)
    ends, out, at = np.append(edge[1:], len(p.code)), [], 0
    while at < len(edge):
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(sums[at:]), most, side="right")))
        out.append(hits(pool, p.take(slice(edge[at], ends[end - 1])), length, most))
        at = end
    return np.concatenate(out) if out else np.zeros(0, bool)


def spans_of(p: Pieces, gone: np.ndarray, length: int) -> list[np.ndarray]:
    """Documents, texts, first bytes and ends of runs of strings that are gone."""
    piece = np.repeat(np.arange(len(p.doc)), p.count)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(p.count) - p.count, p.count)
    edge = np.ones(len(piece), bool)
    edge[1:] = (piece[1:] != piece[:-1]) | (gone[1:] != gone[:-1])
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(piece)) - 1
    start, end = start[gone[start]], end[gone[start]]
    of = piece[start]
    return [p.doc[of], p.row[of], p.at[of] + place[start], p.at[of] + place[end] + length]


def _sent(pool: np.ndarray, p: Pieces, part: np.ndarray, length: int) -> list[tuple]:
    """Rows (part, packed, text) of fragments."""
    out = []
    for number, rows in _dealt(part):
        x = p.take(rows)
        out.append((number, pack([x.code, x.doc, x.row, x.at, x.count, x.salts]), zstandard.compress(x.bytes_of(pool, length).tobytes(), 1)))
    return out


def _received(rows: list[tuple], length: int) -> tuple[np.ndarray, Pieces]:
    """The bytes and fragments of rows, sorted by anchor and document."""
    packed = [unpack(x) for x, _ in rows]
    pool = np.frombuffer(b"".join([zstandard.decompress(t) for _, t in rows]), dtype=np.uint8)
    code, doc, row, at, count, salts = (np.concatenate(c) for c in zip(*packed, strict=True))
    p = Pieces(code, doc, row, at, count, np.cumsum(count + length - 1) - (count + length - 1), salts)
    return pool, p.take(np.lexsort((doc, code)))


def _cut_out(length: int, anchor: int, parts: int):
    """The documents' fragments with shared codes, packed by part; and as spans (part -1) what others of the slice remove."""

    def run(batches):
        for b in _scans(batches):
            docs, rows, texts, wanted = b.column(0).to_numpy(), b.column(1).to_numpy(), _bytes(b.column(2)), b.column(3)
            which, wanted = np.repeat(np.arange(len(docs)), np.diff(wanted.offsets.to_numpy())), wanted.flatten().to_numpy()
            code, text, at, count = fragments(texts, length, anchor)
            code = short(code)
            keyed = lambda c, w: mix(c.astype(np.uint64) + mix(w.astype(np.uint64) + _ODD))
            wanted, salts = wanted & ((1 << _CODE_BITS) - 1), wanted >> _CODE_BITS
            order = np.argsort(known := keyed(wanted, which))
            known, salts = known[order], salts[order]
            mine = keyed(code, text)
            place = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
            keep = np.flatnonzero(known[place] == mine) if len(known) else np.zeros(0, np.int64)
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            pool, begin = np.frombuffer(b"".join(texts) or b" ", dtype=np.uint8), np.cumsum(sizes) - sizes
            text, at = text[keep], at[keep]
            p = Pieces(code[keep], docs[text].astype(np.int64), rows[text].astype(np.int64), at, count[keep], begin[text] + at, salts[place[keep]])
            p = p.take(np.lexsort((p.doc, p.code)))
            edge = np.flatnonzero(np.diff(p.code, prepend=-1))
            out, left = [], p
            if len(edge):
                n = np.diff(np.append(edge, len(p.code)))
                several = np.repeat((n >= FEW) & (np.minimum.reduceat(p.doc, edge) != np.maximum.reduceat(p.doc, edge)), n)
                met = p.take(several)
                gone = decide(pool, met, length)
                if gone.any():
                    out.append((-1, pack(spans_of(met, gone, length)), b""))
                stays = np.ones(len(p.code), bool)
                stays[several] = ~wholly(met, gone)
                left = p.take(stays)
                salt = mix(docs[:1].astype(np.uint64)).astype(np.int64) & ((1 << 40) - 1)
                salted = mix((left.code + (salt % left.salts) * (1 << _CODE_BITS)).astype(np.uint64)).astype(np.int64) & ((1 << 40) - 1)
                out += _sent(pool, left, np.where(left.salts > 1, salted, left.code) % parts, length)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "packed", "text"])

    return run


_SPANS = "doc long, row long, first int, `end` int, part int, packed binary, text binary"


def _removed(length: int, parts: int):
    """Spans that parts with all rows of their anchors remove, and rows (part, packed, text) of what is left of salted anchors."""

    def run(batches):
        for part, rows in _parts(batches, 2):
            if part < 0:
                found, again = [np.concatenate(c) for c in zip(*(unpack(x) for x, _ in rows), strict=True)], []
            else:
                pool, p = _received(rows, length)
                gone = decide(pool, p, length)
                found = spans_of(p, gone, length)
                left = p.take((p.salts > 1) & ~wholly(p, gone))
                again = _sent(pool, left._replace(salts=np.ones_like(left.salts)), left.code % parts, length)
            n, m = len(found[0]), len(again)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            columns = [pa.concat_arrays([pa.array(c).cast(k), pa.nulls(m, k)]) for c, k in zip(found, kinds, strict=True)]
            columns += [pa.concat_arrays([pa.nulls(n, k), pa.array([r[i] for r in again], k)]) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "row", "first", "end", "part", "packed", "text"])

    return run


def _merged(spans: pa.ListArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, first byte and end of the spans of each text that has the row, put together where they meet."""
    flat = spans.flatten()
    text = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()) if len(spans) else 0)
    row, first, end = (flat.field(n).to_numpy().astype(np.int64) for n in ("row", "first", "end"))
    own = row == rows[text]
    text, first, end = text[own], first[own], end[own]
    order = np.lexsort((first, text))
    text, first, end = text[order], first[order], end[order]
    reach = np.maximum.accumulate((text << 32) + end) if len(text) else end
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] << 32) + first[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(text)) - 1
    return text[at], first[at], reach[last] & 0xFFFFFFFF if len(at) else end[:0]


def _without(batches):
    """Digests of what is left of each text."""
    for b in slices(batches, 2):
        texts = _bytes(b.column(2))
        text, first, end = _merged(b.column(3), b.column(1).to_numpy())
        edge = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        first, end, kept = first.tolist(), end.tolist(), []
        for t, lo, hi in zip(texts, edge[:-1], edge[1:], strict=True):
            begins, ends = [0, *end[lo:hi]], [*first[lo:hi], len(t)]
            kept.append(b"".join([t[x:y] for x, y in zip(begins, ends, strict=True)]) if hi > lo else t)
        span = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["first", "end"])
        sizes = [len(t) for t in texts]
        columns = [
            pa.array(sizes, pa.int64()), pa.array([n - len(k) for n, k in zip(sizes, kept, strict=True)], pa.int64()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), span),
            pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """Key, n_bytes, n_removed, spans (merged, of bytes), kept (the remaining bytes; left out without with_text) and kept_sha256."""
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} is {df.schema[key].dataType.simpleString()}; keys are integers")
    tables, kind = Tables(df.sparkSession), df.schema[key].dataType
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    docs = docs.select("doc", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("row"), "text")
    tasks = tasks_of(docs, TASK)
    parts = PARTS * tasks
    sound, keyless = docs.where(F.col("doc").isNotNull()), docs.where(F.col("doc").isNull())
    together = lambda d: d.repartition(tasks, F.when(F.col("part") < 0, F.xxhash64("packed")).otherwise(F.col("part"))).sortWithinPartitions("part")
    codes_ = map_batches(sound, _anchored(length, anchor, parts), "part int, packed binary")
    shared = tables.keep(map_batches(together(codes_), _shared(hot), "doc long, code long"))
    salts, plain = F.shiftright("code", _CODE_BITS), F.col("code").bitwiseAND((1 << _CODE_BITS) - 1)
    many = shared.where(salts > 1).groupBy(plain.alias("c")).agg(F.max(salts).alias("s"))
    salted = not many.isEmpty()
    if salted:  # documents known to share a code don't know its salts
        all_of = shared.select("doc", plain.alias("c")).join(many, "c", "left")
        shared = tables.keep(all_of.select("doc", F.col("c").bitwiseOR(F.shiftleft(F.coalesce("s", F.lit(1).cast("long")), _CODE_BITS)).alias("code")))
    listed = shared.groupBy("doc").agg(F.collect_list("code").alias("codes"))
    pieces = map_batches(sound.join(listed, "doc").select("doc", "row", "text", "codes"), _cut_out(length, anchor, parts), "part int, packed binary, text binary")
    found = map_batches(together(pieces), _removed(length, parts), _SPANS)
    if salted:
        first = tables.keep(found)
        found = first.unionByName(map_batches(together(first.where("part IS NOT NULL").select("part", "packed", "text")), _removed(length, parts), _SPANS))
    merged = found.where("part IS NULL").groupBy("doc").agg(F.collect_list(F.struct("row", "first", "end")).alias("spans"))
    whole = sound.join(merged, "doc", "left").select("doc", "row", "text", "spans")
    none = keyless.select("doc", "row", "text", F.lit(None).cast("array<struct<row: long, first: int, `end`: int>>").alias("spans"))
    ddl = "doc long, n_bytes long, n_removed long, spans array<struct<first: int, `end`: int>>, kept binary, kept_sha256 string"
    # the union is of results, so that both joins read one exchange of the texts
    out = map_batches(whole, _without, ddl).unionByName(map_batches(none, _without, ddl))
    out = out.withColumn("doc", F.col("doc").cast(kind))
    return out.withColumnRenamed("doc", key) if with_text else out.drop("kept").withColumnRenamed("doc", key)
