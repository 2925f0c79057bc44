"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest pivots, in order. Inverted lists are kept for pairs of pivots: two vectors that
share two of their nearest pivots, in any order, meet in the list of a pair that both have. There a 64-bit sign sketch
sorts out the entries that have no close partner (at `FAR` bits or more a pair within the threshold is not expected once
in ten million); of the others the vectors are fetched, and every pair is verified in double precision.

Vectors of each length have an index of their own, as vectors of different lengths have no cosine. Its pivots are a sample
of them, those with the lowest hash, `PIVOTS` or more: they double while they are below half the square root of the
number of vectors, up to `MOST_PIVOTS`, so that lists stay short; with every two doublings one more of the nearest counts.
How many of the nearest count is then measured (`fitted`): on `SAMPLE` further vectors, each with a partner at exactly the
threshold in the direction of another one and of its neighbour, it rises until `WANTED` of these pairs meet. Where up to
`WIDEST` don't suffice for `LEAST` of them, as with few dimensions or a common direction of all, or where the lists would
be no less work than all pairs, the index has two pivots, which all vectors share: one list, in blocks, that leaves no pair
out. So have up to `BLOCK` vectors. Every vector is indexed. A pair that meets in several lists counts in one only, that of its first two
shared pivots. Lists of any length are dealt to tasks in blocks of `BLOCK` entries, by pairs of blocks. Equal vectors are
one entry with a weight. A list gives, for each entry, its number of links and one edge to the least entry that it is
connected with there, so never all pairs.

Vectors that are null, zero, or that hold nulls or values that aren't finite, and those with a null label, link with
nothing, and so do rows with a null id. Rows that repeat an id are separate vectors of the same id.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.batches import map_batches
from .blocks import groups_of, roots
from .common import Tables
from .components import components

THRESHOLD = 0.93
PIVOTS, NEAREST, MOST_PIVOTS = 128, 6, 4096
#: Vectors that measure the index, shares of pairs at the threshold that shall and must meet, most of the nearest pivots that count.
SAMPLE, WANTED, LEAST, WIDEST = 512, 0.99, 0.95, 16
SKETCH_BITS, FAR = 64, 24
BLOCK = 2048
_SHIFT = 20  # bits of a pivot's number


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def planes(width: int) -> np.ndarray:
    return np.random.default_rng(20240607).standard_normal((width, SKETCH_BITS))


def permutations(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of each unit vector's nearest pivots, nearest first."""
    return np.argsort(-(vectors @ pivots.T).round(9), axis=1, kind="stable")[:, :nearest]


def size_of_index(n: int, pivots: int = PIVOTS, nearest: int = NEAREST, most: int = MOST_PIVOTS) -> tuple[int, int]:
    """How many pivots, and how many of the nearest, for n vectors."""
    doubled = max(0, math.ceil(math.log2(max(1.0, math.sqrt(n) / 2 / pivots))))
    doubled = min(doubled, max(0, int(math.log2(max(1.0, most / pivots)))))
    return pivots << doubled, nearest + (doubled + 1) // 2


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(row: str, vector: str, label: str) -> Column:
    """Whether a row's vector can link: neither null nor zero, all values finite, and neither id nor label null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.exists(vector, lambda x: x != 0) & finite, F.lit(False)) & F.col(label).isNotNull() & F.col(row).isNotNull()


def describe(entries: DataFrame, pivots: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """e, weight, label, v; width, order (the permutation) and sketch. pivots: by width, unit vectors and how many of the nearest count."""

    def run(batches):
        for b in batches:
            widths = np.diff(b.column(3).offsets.to_numpy()) if b.num_rows else np.zeros(0, np.int64)
            for width in np.unique(widths).tolist():
                part = b.take(pa.array(np.flatnonzero(widths == width)))
                x, (points, nearest) = unit(_rows(part.column(3), width)), pivots[width]
                order = pa.array(list(permutations(x, points, nearest).astype(np.int32)), pa.list_(pa.int32()))
                bits = np.packbits((x @ planes(width)) > 0, axis=1).view(">i8").astype(np.int64).reshape(-1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(x), width, np.int32)), order, pa.array(bits)], names=["e", "weight", "label", "v", "width", "order", "sketch"])

    kinds = {f.name: f.dataType.simpleString() for f in entries.schema}
    return map_batches(entries.select("e", "weight", "label", "v"), run, f"e long, weight long, label {kinds['label']}, v {kinds['v']}, width int, order array<int>, sketch long")


def _halves(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the two blocks that are compared, and whether they are the same block."""
    block, i, j = (table.column(c).to_numpy() for c in ("block", "i", "j"))
    if i[0] == j[0]:
        every = np.arange(len(block))
        return every, every, True
    return np.flatnonzero(block == i), np.flatnonzero(block == j), False


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64))


def _close(batches):
    """Entries that have a partner with a close sketch in their list."""
    for g in groups_of(batches, ["label", "pair", "i", "j"]):
        left, right, same = _halves(g)
        if not len(left) or not len(right) or (same and len(left) < 2):
            continue
        s = g.column("sketch").to_numpy()
        near = _hamming(s[left], s[right]) < FAR
        if same:
            np.fill_diagonal(near, False)
        rows = np.union1d(left[near.any(axis=1)], right[near.any(axis=0)])
        if len(rows):
            yield from g.take(rows).select(["pair", "i", "j", "block", "e"]).to_batches()


def _verify(threshold: float):
    def run(batches):
        for g in groups_of(batches, ["label", "pair", "i", "j"]):
            left, right, same = _halves(g)
            if not len(left) or not len(right) or (same and len(left) < 2):
                continue
            order, v = g.column("order").combine_chunks(), g.column("v").combine_chunks()
            x = unit(_rows(v, len(v[0])))
            cos = x[left] @ x[right].T
            if same:
                cos = np.triu(cos, 1)
            a, b = np.nonzero(cos >= threshold - 1e-9)
            a, b = left[a], right[b]
            near = _rows(order, len(order[0])).astype(np.int64)
            weight, pair = g.column("weight").to_numpy(), int(g.column("pair")[0].as_py()) & ((1 << 2 * _SHIFT) - 1)
            found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low in range(0, len(a), 1 << 16):
                c, d = a[low : low + (1 << 16)], b[low : low + (1 << 16)]
                exact = (x[c] * x[d]).sum(axis=1) >= threshold
                shared = (near[c][:, :, None] == near[d][:, None, :]).any(axis=2)
                numbers = np.sort(np.where(shared, near[c], 1 << _SHIFT), axis=1)
                mine = (numbers[:, 0] << _SHIFT) + numbers[:, 1] == pair
                found[0].append(c[exact & mine])
                found[1].append(d[exact & mine])
            a, b = (np.concatenate(f) for f in found)
            if not len(a):
                continue
            e = g.column("e").to_numpy()
            by = np.argsort(e, kind="stable")
            place = np.empty(len(e), np.int64)
            place[by] = np.arange(len(e))
            links = np.bincount(a, weight[b], len(e)) + np.bincount(b, weight[a], len(e))
            root = by[roots(len(e), place[a], place[b])][place]
            rows = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(e[rows]), pa.array(e[root[rows]]), pa.array(links[rows].astype(np.int64))], names=["e", "root", "links"])

    return run


def at_threshold(x: np.ndarray, toward: np.ndarray, threshold: float) -> np.ndarray:
    """Unit vectors at the cosine of the threshold to each x, in the direction of another vector; that itself where it is nearer."""
    cos = (x * toward).sum(axis=1, keepdims=True)
    aside = toward - cos * x
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.where(length > 1e-9, aside / np.maximum(length, 1e-9), 0)
    return np.where(cos >= threshold, toward, unit(threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * aside))


def fitted(sample: np.ndarray, pivots: np.ndarray, nearest: int, threshold: float) -> int | None:
    """How many of the nearest pivots must count so that pairs at the threshold meet; None if the index doesn't pay."""
    n, near = len(sample), sample @ sample.T
    np.fill_diagonal(near, -2)
    random = np.roll(np.arange(n), 1)
    neighbours = near.argmax(axis=1)
    widest = min(WIDEST, len(pivots))
    mine = permutations(sample, pivots, widest)
    partners = [permutations(at_threshold(sample, sample[to], threshold), pivots, widest) for to in (random, neighbours)]
    best = None
    for k in range(nearest, widest + 1):
        shared = lambda other: (mine[:, :k, None] == other[:, None, :k]).any(axis=2).sum(axis=1)  # noqa: B023, E731
        met = min(float((shared(p) >= 2).mean()) for p in partners)
        common = shared(mine[random])
        if (common * (common - 1) / 2).mean() >= 0.5:  # lists hold as many pairs as there are
            break
        if best is None or met > best[0]:
            best = met, k
        if met >= WANTED:
            break
    return best[1] if best and best[0] >= LEAST else None


def pivots_of(entries: DataFrame, pivots: int, nearest: int, most: int, threshold: float) -> dict[int, tuple[np.ndarray, int]]:
    """For each length of vectors, its pivots and how many of the nearest count. Only the pivots and the sample come to the driver."""
    out = {}
    sizes = {r["w"]: r["n"] for r in entries.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()}
    for width, n in sorted(sizes.items()):
        axis = np.eye(1, width)
        out[width] = np.vstack([axis, -axis]), 2  # all vectors share both
        if n <= BLOCK:
            continue
        asked, close = size_of_index(n, pivots, nearest, most)
        rows = entries.where(F.size("v") == width).orderBy(F.xxhash64("v"), "e").limit(asked + SAMPLE).collect()
        points = unit(np.array([r["v"] for r in rows], dtype=np.float64))
        points, sample = points[:asked], points[asked:]
        if len(sample) < 2:
            continue
        if close := fitted(sample, points, min(close, len(points)), threshold):
            out[width] = points, close
    return out


def links(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, pivots: int = PIVOTS, nearest: int = NEAREST, most_pivots: int = MOST_PIVOTS
) -> DataFrame:
    """Key, n_links, component_id and kept of each row of df (see the module)."""
    if not (2 <= nearest <= pivots <= most_pivots < 1 << _SHIFT):
        raise ValueError(f"2 <= nearest <= pivots <= most_pivots < {1 << _SHIFT} must hold")
    tables = Tables(df.sparkSession)
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    sound = rows.where(usable("id", "v", "label"))
    entries = sound.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).withColumn("e", F.monotonically_increasing_id())
    entries = tables.keep(entries)
    points = pivots_of(entries, pivots, nearest, most_pivots, threshold)
    table = tables.keep(describe(entries, points))
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    # a pair of pivots, its length of vectors above both
    number = lambda i, j: (F.col("width").cast("long") * (1 << 2 * _SHIFT)) + F.least(i, j).cast("long") * (1 << _SHIFT) + F.greatest(i, j).cast("long")
    most = max((k for _, k in points.values()), default=2)
    at_place = lambda i: F.get("order", F.lit(i))
    pairs = F.array_compact(F.array(*(F.when(F.size("order") > j, number(at_place(i), at_place(j))) for i, j in itertools.combinations(range(most), 2))))
    lists = table.select("e", "label", "sketch", F.explode(pairs).alias("pair"))
    sizes = lists.groupBy("label", "pair").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = lists.join(sizes, ["label", "pair"]).withColumn("block", F.pmod(F.xxhash64("e"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    at = ["label", "pair", "i", "j"]
    together = lambda d: d.repartition(*at).sortWithinPartitions(*at)
    close = map_batches(together(dealt.select(*at, "block", "e", "sketch")), _close, "pair long, i int, j int, block int, e long")
    fetched = close.join(table.select("e", "label", "weight", "v", "order"), "e")
    partial = tables.keep(map_batches(together(fetched.select(*at, "block", "e", "weight", "v", "order")), _verify(threshold), "e long, root long, links long"))
    tables.drop(table)
    whole = components(partial, "e", "root")
    least = whole.join(entries.select(F.col("e").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "component").select(F.col("node").alias("e"), "component_id")
    sums = partial.groupBy("e").agg(F.sum("links").alias("links")).join(named, "e", "left")
    classes = tables.keep(entries.join(sums, "e", "left").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")))
    tables.drop(entries, partial)
    linked = sound.join(classes, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable("id", "v", "label")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = f"""
    WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
    r AS (WITH RECURSIVE c(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a) SELECT a, min(b) AS m FROM c GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, m AS component_id, vec_id = m AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN r ON r.a = vec_id"""
