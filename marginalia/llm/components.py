"""Connected components of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and all its v; aggregated before it is joined, so that no group is collected."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    found = _with_least(down)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _edges(links: DataFrame, a: str, b: str) -> DataFrame:
    return links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """Node and component after one step: nodes of one component are connected, but connected ones may still differ."""
    return _large_star(_edges(links, a, b)).groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Node and component (its least node), of all nodes that have a link. Each round is a table of its own."""
    tables = Tables(links.sparkSession)
    edges, seen = tables.keep(_edges(links, a, b)), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("bit_xor(xxhash64(v, u, 1))").alias("y")).first()
        if now == seen or not now["n"]:
            break
        seen, last = now, edges
        edges = tables.keep(_small_star(_large_star(edges)))
        tables.drop(last)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
