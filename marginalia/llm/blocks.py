"""Blocks of rows inside a task: groups of sorted batches, and components of edges between rows."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa


def groups_of(batches, by: list[str]):
    """Whole groups of rows from batches that are sorted by the columns `by`."""
    held = None
    for b in batches:
        table = pa.Table.from_batches([b])
        held = table if held is None or not held.num_rows else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        keys = [held.column(c).to_numpy(zero_copy_only=False) for c in by]
        new = np.zeros(held.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(new)]
        for a, e in itertools.pairwise(cuts):
            yield held.slice(a, e - a)
        held = held.slice(cuts[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, by minima along edges and pointers."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == root).all():
            return root
        root = now
