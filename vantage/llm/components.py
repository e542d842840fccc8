"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import stash


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours; stored, so that the join with a
    hub's many edges has an exchange of its own on both sides and can be split."""
    return stash(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v; any order, repeats
    and loops allowed); component is the smallest node that can be reached.

    Each round is two aggregations and two joins on the edge table, which is stored
    between rounds; the number of rounds grows with the logarithm of the longest
    chain.  Only a row count and a checksum reach the driver."""
    u, v = F.col("u"), F.col("v")
    now = stash(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        large = both.join(_lowest(both), "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large)
        low = _lowest(large)
        small = large.join(low, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        now = stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = _mark(now)
        if new == mark:
            break
        mark = new
    roots = now.select(v.alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(u.alias("node"), v.alias("component")).unionByName(roots)
