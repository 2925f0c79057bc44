"""What the vector index finds where vectors share a direction or have few dimensions; rows that near-duplicate removal keeps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import bag_minhash, pivot_index


def _cone(rng, n, width, typical):
    """Vectors of a common direction; two have the typical cosine."""
    x = np.sqrt(1 - typical) * pivot_index.unit(rng.standard_normal((n, width)))
    x[:, 0] += np.sqrt(typical)
    return x


def _planted(rng, x, n):
    """n partners of the vectors, at cosines from 0.9 to 0.99 in the direction of others."""
    x = pivot_index.unit(x)
    return np.vstack([pivot_index.at_threshold(x[i : i + 1], x[j : j + 1], c) for i, j, c in zip(rng.integers(len(x), size=n), rng.integers(len(x), size=n), rng.uniform(0.9, 0.99, n), strict=True)])


def _vectors(kind):
    rng = np.random.default_rng(len(kind))
    if kind.startswith("cone"):
        x = _cone(rng, 1500, 64, float(kind[5:]))
    elif kind.startswith("width"):
        x = rng.standard_normal((1200, int(kind[6:])))
    else:
        x = np.repeat(rng.standard_normal((30, 48)), 40, axis=0) + 0.3 * rng.standard_normal((1200, 48))
    return np.vstack([x, _planted(rng, x, 150)])


@pytest.mark.parametrize(("kind", "block"), [("cone 0.9", 256), ("cone 0.8", 256), ("width 2", 256), ("width 3", 256), ("width 8", 256), ("clusters", 256), ("cone 0.9", 2048)])
def test_links_are_found_in_all_shapes(spark, monkeypatch, kind, block):
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    x = _vectors(kind)
    rows = [(i, "l", v.tolist()) for i, v in enumerate(x)]
    found = {r["vec_id"]: r for r in pivot_index.links(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    u = pivot_index.unit(x)
    near = u @ u.T >= pivot_index.THRESHOLD
    np.fill_diagonal(near, False)
    right = near.sum(axis=1)
    got = np.array([found[i]["n_links"] for i in range(len(x))])
    assert (got <= right).all() and got.sum() >= 0.99 * right.sum() > 0
    if block == 2048:
        assert (got == right).all()


def test_indexes_that_do_not_pay_are_left():
    rng = np.random.default_rng(3)
    for width, kept in ((64, True), (2, False)):
        x = pivot_index.unit(rng.standard_normal((700, width)))
        assert (pivot_index.fitted(x[128:], x[:128], 6, 0.93) is not None) == kept


def test_unlike_rows_of_a_document_stay(spark):
    rows = [(1, "one two three four five six", "en"), (1, "one two three four five six", "de"), (1, "one two three four five six", "de"), (2, "one two three four five six", "en"), (None, "x", "en"), (None, "x", "en"), (3, None, "fr"), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted(map(tuple, bag_minhash.clean(df).collect()), key=str)
    assert kept == sorted([r for i, r in enumerate(rows) if i not in (2, 3)], key=str)
    maps = df.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert bag_minhash.clean(maps).count() == 7
