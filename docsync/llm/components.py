"""Connected components by alternating large and small stars, on shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import stored


def large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = both.filter("v > u").join(least, "u")
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    across = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): component is its least node.

    Both steps work on minima, which are added up before they travel, so a node with very many
    links is not gathered anywhere. Each round is a table in the shared folder; one row
    with a count and a sum of hashes tells the driver whether anything changed.
    """
    oriented = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stored(oriented.distinct(), "edges")
    mark = None
    while True:
        sign = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        found = tuple(now.agg(F.count("*"), sign).first())
        if found == mark:
            break
        mark = found
        now = stored(small_star(stored(large_star(now), "large_star")), "small_star")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
