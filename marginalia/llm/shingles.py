"""Hashes of word shingles, vectorised over the bytes of many texts at once.

A word is a run of letters and digits of ASCII, with A-Z as a-z, and of all other characters above ASCII. A shingle is
`size` consecutive words; a text of fewer words, but not none, has one shingle of them all.
"""

from __future__ import annotations

from functools import cache, lru_cache

import numpy as np

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x5851F42D4C957F2D
#: Bytes of text that are hashed at once.
BLOCK = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


@cache
def _tables():
    codes = np.arange(256, dtype=np.uint8)
    low = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    word = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    return mix(low.astype(np.uint64) + np.uint64(0x9E37)), word


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _room(n: int) -> int:
    """Sizes of tables double, so that few are kept."""
    size = 1 << 16
    while size < n:
        size *= 2
    return size


def hashed(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The shingle hashes of each text, sorted."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8) if texts else np.zeros(0, np.uint8)
    values, word = _tables()
    inside = word[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    room = _room(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * _powers(_P, room)[: len(data)], out=sums[1:])
    words = mix((sums[end] - sums[begin]) * _powers(pow(_P, -1, 1 << 64), room)[begin] + (end - begin).astype(np.uint64))
    first = np.searchsorted(begin, np.concatenate([[0], ends[:-1]])) if len(ends) else []
    last = [*first[1:], len(words)]
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(_P) + words[k : n + k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first, last, strict=True):
        if b - a >= size:
            out.append(np.sort(rolled[a : b - size + 1]))
        elif b > a:
            short = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    short = short * np.uint64(_P) + w
            out.append(mix(np.array([short + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def occurrences(sorted_hashes: np.ndarray) -> np.ndarray:
    """Of each element of a sorted array, how many equal ones stand before it."""
    n = len(sorted_hashes)
    new = np.ones(n, bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(new, at, 0))


def elements(sorted_hashes: np.ndarray) -> np.ndarray:
    """Distinct codes of a multiset: equal shingles get one code for each time that they occur."""
    times = occurrences(sorted_hashes)
    return np.where(times > 0, mix(sorted_hashes + times.astype(np.uint64) * _B), sorted_hashes)
