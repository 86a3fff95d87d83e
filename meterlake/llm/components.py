"""Connected components of a graph of long ids by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterlake.llm.scratch import Scratch


def _linked(edges: DataFrame) -> DataFrame:
    """Each edge once as (u, v) with u > v, loops left out."""
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is hung to the least of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _linked(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are hung to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _linked(hung.unionAll(least.select("u", F.col("m").alias("v"))))


def _fingerprint(edges: DataFrame) -> tuple:
    """Equal for two rounds only if they hold the same edges (but for a chance of 2**-64)."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component_id) for every node with an edge; component_id is the least id reachable.

    ``edges`` has long columns u and v, in any direction, repeats and loops allowed (a node that only has loops is
    left out). Each round is written to the shared folder; rounds grow with the logarithm of the longest path.
    An empty graph gives an empty table.
    """
    now, before = scratch.keep(_linked(edges), "edges"), None
    while (state := _fingerprint(now)) != before and state[0]:
        before, after = state, scratch.keep(_small_star(_large_star(now)), "stars")
        scratch.drop(now)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
