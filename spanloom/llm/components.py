"""Connected components over links as rows, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import lookup, written


def _smallest(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the smallest node among u and its neighbours; a hub's edges are spread."""
    groups = edges.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return lookup(edges.select(F.col("u").cast("string").alias("key"), "u", "v"), groups.select(F.col("u").cast("string").alias("key"), "m", "n"), "key", ["m"], "n", F.concat(F.lit("#"), F.col("v").cast("string")))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    return _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rows = _smallest(down)
    pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
    return rows.select(pairs.alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component for every end of links (a, b): component is the smallest id reachable.

    Each round is a few shuffles of narrow rows and shrinks the graph towards stars, in a
    number of rounds that grows with the logarithm of the longest chain. What is compared
    between rounds on the driver is a count and a sum. Links with a null end are ignored.
    """
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        told = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.least("u", "v"), F.greatest("u", "v")).cast("decimal(38,0)"))).first()
        if tuple(told) == before or not told[0]:
            break
        before = tuple(told)
        edges = written(_small(_large(edges)), "edges")
    stars = edges.select(F.greatest("u", "v").alias("id"), F.least("u", "v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component")).distinct()
