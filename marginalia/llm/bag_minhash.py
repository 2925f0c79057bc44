"""Near-duplicate texts by BagMinHash signatures of their multisets of word shingles.

The weight of a shingle is how often it occurs. Its weight axis is cut in dyadic bins (0,1], (1,2], (2,4], ...; each bin
carries a Poisson process in time whose rate is its width, and each point a place in the bin and a register. A text sees
the points below its weights, and keeps the earliest point of each register, so that two texts agree on a register with
a probability equal to their weighted Jaccard similarity. Points are drawn in order of time up to a horizon that fills
all registers, so that the work is that of the few points before it, not of weights.

Texts with the same multiset are one class, known by a digest of the multiset; all that follows is on classes. Bands of
registers make buckets. Rounds compare the classes of each bucket with one of them, another in each round, and only
where the two are in different components so far; a group of copies so gives links in number of its classes. What is
then still apart in a bucket is compared whole: all of it but the largest component there with all others, in blocks,
of which only links leave. No link between classes of a bucket is lost. Each pair is verified on the exact multisets,
which are made once, for the classes that share a bucket, and kept as a table.

Each key gives one row. Rows with a null key can't be named by it: they are compared with nothing and left out of the
result. Texts without words and null ones are alone. Rows with the same key are one document: their texts are linked.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.batches import map_batches, slices
from . import shingles
from .blocks import groups_of, roots
from .common import Tables
from .components import components, connected

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: Rounds of comparing buckets with one of their classes, and rows of a block of what is compared whole.
ROUNDS, BLOCK = 3, 512
#: Different shingles that a block compares at once.
COLUMNS = 8192
#: A name for what `clean` adds, which no input column may have.
_TURN = "__copy_turn"

_TIME, _PLACE, _REGISTER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0, at most 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / (1 << 53)


def signatures(bags: list[np.ndarray], registers: int) -> np.ndarray:
    """Earliest times (texts, registers) of sorted multisets of hashes that aren't empty."""
    out = np.full((len(bags), registers), np.inf)
    todo, stretch = np.arange(len(bags)), np.log(registers) + 3.0
    codes, weights, counts = [], [], []
    for bag in bags:
        starts = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
        codes.append(bag[starts])
        weights.append(np.diff(np.append(starts, len(bag))))
        counts.append(len(starts))
    sizes = np.array([len(b) for b in bags], dtype=np.float64)
    while len(todo):
        code, weight = np.concatenate([codes[i] for i in todo]), np.concatenate([weights[i] for i in todo])
        row = np.repeat(todo, [counts[i] for i in todo])
        bins = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
        level = np.arange(bins.sum()) - np.repeat(np.cumsum(bins) - bins, bins)
        code, weight, row = np.repeat(code, bins), np.repeat(weight, bins), np.repeat(row, bins)
        low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
        width = np.where(level > 0, low, 1.0)
        seed = shingles.mix(code + level.astype(np.uint64) * _PLACE)
        until = registers * stretch / sizes
        time, step = np.zeros(len(seed)), 0
        while len(seed):
            step += 1
            turn = [np.uint64(step * int(x) % (1 << 64)) for x in (_TIME, _PLACE, _REGISTER)]
            time = time - np.log(_unit(shingles.mix(seed + turn[0]))) / width
            live = time < until[row]
            seed, weight, row, low, width, time = (x[live] for x in (seed, weight, row, low, width, time))
            place = low + width * _unit(shingles.mix(seed ^ turn[1]))
            seen = place <= weight
            register = (shingles.mix(seed + turn[2])[seen] % np.uint64(registers)).astype(np.int64)
            np.minimum.at(out.reshape(-1), row[seen] * registers + register, time[seen])
        todo, stretch = np.flatnonzero(np.isinf(out).any(axis=1)), stretch * 2
    return out


def _digest(elements: np.ndarray) -> np.ndarray:
    """Two numbers of a multiset, as distinct codes."""
    return np.array([shingles.mix(elements).sum(dtype=np.uint64), shingles.mix(elements ^ _TIME).sum(dtype=np.uint64)]).view(np.int64)


def _described(texts: list[bytes], words: int, bands: int, rows: int) -> list[tuple]:
    """(digest in two parts, shingles, band hashes) of each text; no bands for a text without words."""
    bags = shingles.hashed(texts, words)
    full = [i for i, x in enumerate(bags) if len(x)]
    codes = np.zeros((len(bags), bands), dtype=np.uint64)
    if full:
        points = signatures([bags[i] for i in full], bands * rows).view(np.uint64).reshape(len(full), bands, rows)
        mixed = np.zeros((len(full), bands), dtype=np.uint64)
        for k in range(rows):
            mixed = shingles.mix(mixed + points[:, :, k])
        codes[full] = mixed
    return [(*_digest(shingles.elements(x)), len(x), band if len(x) else np.zeros(0, np.int64)) for x, band in zip(bags, codes.view(np.int64), strict=True)]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def describe(df: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """id, c (equal for equal multisets), n (shingles) and codes (one of each band)."""

    def run(batches):
        for b in slices(batches, 1, shingles.BLOCK):
            found = [(np.array(x[:2]).tobytes(), *x[2:]) for x in _described(_bytes(b.column(1)), words, bands, rows)]
            cols = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "c", "n", "codes"])

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(F.col(key).alias("id"), F.col(text).cast("string")), run, f"id {kind}, c binary, n int, codes array<long>")


def bags(texts: DataFrame, words: int) -> DataFrame:
    """c, lead, is_lead and elements of rows (c, text, lead, is_lead) whose text has the digest c, once in each task."""

    def run(batches):
        seen = set()
        for b in slices(batches, 1, shingles.BLOCK):
            each = [shingles.elements(x) for x in shingles.hashed(_bytes(b.column(1)), words)]
            own = [i for i, (d, c) in enumerate(zip(map(_digest, each), b.column(0).to_pylist(), strict=True)) if d.tobytes() == c and not (c in seen or seen.add(c))]
            kept = b.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), kept.column(3), pa.array([each[i].view(np.int64) for i in own], pa.list_(pa.int64()))], names=["c", "lead", "is_lead", "elements"])

    return map_batches(texts.select("c", "text", "lead", "is_lead"), run, "c binary, lead binary, is_lead boolean, elements array<long>")


def _near(x: str, y: str, threshold: float):
    both = F.size(F.array_intersect(x, y))
    return both >= threshold * (F.size(x) + F.size(y) - both)


def verified(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose multisets have a similarity of threshold or more."""
    left, right = known.select(F.col("c").alias("a"), F.col("elements").alias("x")), known.select(F.col("c").alias("b"), F.col("elements").alias("y"))
    return pairs.join(right, "b").join(left, "a").where(_near("x", "y", threshold)).select("a", "b")


def _labelled(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries of buckets with their component so far."""
    named = members.join(groups, members["c"] == groups["node"], "left")
    return named.select("c", "n", F.coalesce("component", "c").alias("component"), F.inline("at"))


def _unfinished(labelled: DataFrame) -> DataFrame:
    """Buckets of several components (of two classes are compared by then): the largest component, and how many classes are outside it."""
    bucket = ["band", "code"]
    parts = labelled.groupBy(*bucket, "component").agg(F.count("*").alias("n_part"))
    sizes = parts.groupBy(*bucket).agg(F.sum("n_part").alias("total"), F.max(F.struct("n_part", "component")).alias("main"), F.count("*").alias("parts"))
    return sizes.where("parts > 1 AND total > 2").select(*bucket, F.col("main.component").alias("main"), (F.col("total") - F.col("main.n_part")).alias("others"))


def _rest_apart(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """What is still to be compared, dealt in groups (g, code, t, u) of rows.

    All classes of a bucket outside its largest component meet each other, in pairs of blocks (g is the band, u = -1), and
    all classes of that component, in blocks t and chunks u; these groups are of the component (g = -1), so that a class
    that meets it in many buckets comes once.
    """
    bucket = ["band", "code"]
    strays = labelled.join(sizes, bucket).where(F.col("component") != F.col("main")).select("c", "component", *bucket, "main", "others")
    of = lambda n: F.ceil(n / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("c"), of(n)).cast("int")
    at = lambda t, u, left: F.struct(t.cast("int").alias("t"), u.cast("int").alias("u"), F.lit(left).alias("is_left"))
    to = lambda n: F.sequence(F.lit(0), of(n) - 1)
    none = F.lit(-1)
    later = F.transform(F.filter(to(F.col("others")), lambda t: t < F.col("own")), lambda t: at(t, none, False))
    among = strays.withColumn("own", own(F.col("others"))).withColumn("x", F.explode(F.concat(F.array(at(F.col("own"), none, True)), later)))
    met = strays.select("main", "c", "component").distinct()
    inside = labelled.select("c", "component").distinct().join(met.select(F.col("main").alias("component")).distinct(), "component")
    counts = met.groupBy("main").agg(F.count("*").alias("n_left")).join(inside.groupBy(F.col("component").alias("main")).agg(F.count("*").alias("n_right")), "main")
    left = met.join(counts, "main").withColumn("x", F.explode(F.transform(to(F.col("n_right")), lambda u: at(own(F.col("n_left")), u, True))))
    right = inside.withColumn("main", F.col("component")).join(counts, "main").withColumn("x", F.explode(F.transform(to(F.col("n_left")), lambda t: at(t, own(F.col("n_right")), False))))
    named = lambda d: d.select("c", "component", F.lit(-1).alias("g"), F.xxhash64("main").alias("code"), "x.*")
    return among.select("c", "component", F.col("band").alias("g"), "code", "x.*").unionByName(named(left)).unionByName(named(right))


def overlaps(sets: pa.ListArray, left: np.ndarray) -> np.ndarray:
    """Shared elements of each of the left sets with every set, some columns at a time."""
    sizes = np.diff(sets.offsets.to_numpy())
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    often = count[code] > 1
    owner, code = owner[often], (np.cumsum(count > 1) - 1)[code[often]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(left), len(sets)))
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [low, low + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[owner[a:b], code[a:b] - low] = 1
        out += held[left] @ held.T
    return out


def _linked(threshold: float):
    """Edges between classes of different components in each group of rows, one for each class at most."""

    def run(batches):
        for g in groups_of(batches, ["g", "code", "t", "u"]):
            ids = g.column("c").to_numpy(zero_copy_only=False)
            _, part = np.unique(g.column("component").to_numpy(zero_copy_only=False), return_inverse=True)
            sets = g.column("elements").combine_chunks()
            sizes = np.diff(sets.offsets.to_numpy()).astype(np.float64)
            a = np.flatnonzero(g.column("is_left").to_numpy(zero_copy_only=False))
            both = overlaps(sets, a)
            near = (both >= threshold * (sizes[a][:, None] + sizes[None, :] - both)) & (part[a][:, None] != part[None, :])
            x, y = np.nonzero(near)
            if len(x):
                root = roots(len(ids), a[x], y)
                rows = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.binary()), pa.array(ids[root[rows]], pa.binary())], names=["a", "b"])

    return run


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Key, class_id (least key of the texts with the same multiset), component_id (least key that is linked to it) and kept."""
    tables, bucket = Tables(df.sparkSession), ["band", "code"]
    sound = tables.keep(describe(df.where(F.col(key).isNotNull()), key, text, words, bands, rows))
    classes = tables.keep(sound.where("n > 0").groupBy("c").agg(F.min(F.struct("id", "n", "codes")).alias("best")).select("c", "best.*"))
    entries = classes.select("c", "id", "n", F.posexplode("codes").alias("band", "code"))
    # what is joined to the members of buckets is a table, so that a large bucket may be dealt to several tasks
    shared = tables.keep(entries.groupBy(*bucket).agg(F.min(F.struct("c", "n")).alias("first"), F.count("*").alias("size")).where("size > 1").drop("size"))
    alike = lambda m, n: F.least(m, n) >= threshold * F.greatest(m, n)
    fits = (F.col("first.c") != F.col("c")) & alike(F.col("n"), F.col("first.n"))
    own = F.struct(*bucket), F.when(fits, F.col("first.c"))
    members = entries.join(shared, bucket).groupBy("c").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.collect_list(own[0]).alias("at"), F.min(own[1]).alias("lead"))
    members = tables.keep(members)
    tables.drop(shared)
    leads = members.select(F.col("lead").alias("l")).where("l IS NOT NULL").distinct()
    wanted = members.join(leads, F.col("c") == F.col("l"), "left").select("c", "id", "lead", F.col("l").isNotNull().alias("is_lead"))
    texts = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(wanted, "id")
    known = tables.keep(bags(texts, words))
    first = known.where("lead IS NOT NULL").select(F.col("lead").alias("b"), F.col("c").alias("a"), F.col("elements").alias("x"))
    first = first.join(known.where("is_lead").select(F.col("c").alias("b"), F.col("elements").alias("y")), "b").where(_near("x", "y", threshold))
    links = [tables.keep(first.select("a", "b"))]
    groups = tables.keep(connected(links[0], "a", "b"))
    for turn in range(1, ROUNDS):
        labelled = _labelled(members, groups)
        order = -F.xxhash64("c") if turn % 2 else F.xxhash64("c")
        lead = labelled.groupBy(*bucket).agg(
            F.min(F.struct(order.alias("k"), "c", "n", "component")).alias("lead"), F.min("component").alias("low"), F.max("component").alias("high")
        )
        lead = tables.keep(lead.where("low <> high").select(*bucket, F.col("lead.c").alias("o"), F.col("lead.n").alias("m"), F.col("lead.component").alias("oc")))
        pairs = labelled.join(lead, bucket).where((F.col("component") != F.col("oc")) & alike(F.col("n"), F.col("m")))
        pairs = tables.keep(pairs.select(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b")).distinct())
        if not pairs.isEmpty():
            links.append(tables.keep(verified(pairs, known, threshold)))
            last, groups = groups, tables.keep(connected(_together(links), "a", "b"))
            tables.drop(last)
        tables.drop(pairs, lead)
    labelled = _labelled(members, groups)
    sizes = tables.keep(_unfinished(labelled))
    apart = tables.keep(_rest_apart(labelled, sizes))
    tables.drop(members, groups, sizes)
    if not apart.isEmpty():
        at = ["g", "code", "t", "u"]
        dealt = apart.join(known.select("c", "elements"), "c").select(*at, "is_left", "component", "c", "elements").repartition(*at).sortWithinPartitions(*at)
        links.append(tables.keep(map_batches(dealt, _linked(threshold), "a binary, b binary")))
    tables.drop(apart, known)
    same = sound.where("n > 0").groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b")
    several = sound.where("n > 0").join(same.select("id", "a"), "id").where("c <> a").select("a", F.col("c").alias("b"))
    groups = components(_together(links).unionByName(several), "a", "b")
    tables.drop(*links)
    named = classes.select("c", F.col("id").alias("class_id")).join(groups, F.col("c") == F.col("node"), "left").select("c", "class_id", "component")
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "component", "left").select("c", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    with_words = sound.where("n > 0").select("id", "c").join(named, "c").select("id", "class_id", "component_id")
    without = sound.where("n = 0").select("id", F.lit(None).cast(sound.schema["id"].dataType).alias("class_id"), F.lit(None).cast(sound.schema["id"].dataType).alias("component_id"))
    out = with_words.unionByName(without).groupBy("id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
    out = out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(key), "class_id", "component_id", (F.col("component_id") == F.col("id")).alias("kept"))


def clean(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each group of near copies; rows with a null key stay.

    All rows of that key stay but those that are alike in every column, which stay once (all of them, if a column holds
    maps, which can't be compared).
    """
    first = near_duplicates(df, key, text).where("kept").select(key)
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg((F.count("*") > 1).alias(_TURN))
    rest = df.join(Tables(df.sparkSession).keep(first.join(rows, key)), key)
    several = rest.where(F.col(_TURN)).select(*df.columns)
    if "map<" not in df.schema.simpleString():
        several = several.dropDuplicates()
    return rest.where(~F.col(_TURN)).select(*df.columns).unionByName(several).unionByName(df.where(F.col(key).isNull()))


def _together(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out
