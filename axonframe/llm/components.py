"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.plans.session import cut


def _is_star_forest(edges: DataFrame) -> bool:
    """True if every u has one edge and no v is a u; edges point from larger u to smaller v."""
    twice = edges.groupBy("u").count().filter("count > 1").select("u")
    middle = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return twice.union(middle).limit(1).count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node but the roots, where component is the smallest id reachable.

    ``edges``: (u, v) of longs; loops, repeats, either direction and an empty table are fine. Each
    round maps every neighbourhood to its smallest member: O(log^2 n) rounds, each linear in the
    edges, with partial aggregation before the shuffle; lineage is cut after each.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _is_star_forest(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
