"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node of the neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("low").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    low = edges.groupBy("b").agg(F.min("a").alias("low"))
    others = edges.join(low, "b").where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return others.unionByName(low.select(F.col("low").alias("a"), "b"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("sum(pmod(xxhash64(a, b), 1099511627776))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (a < b, longs) is connected to. Nodes without edges are left out.

    Every step is written to the shared folder, which cuts the lineage; steps grow with the logarithm of the components' size.
    """
    current = materialize(edges.distinct())
    state = _state(current)
    while state[0]:
        following = materialize(_small_star(_large_star(current).distinct()).distinct())
        now = _state(following)
        current, done = following, now == state
        state = now
        if done:
            break
    ties = current.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return ties.unionByName(ties.select(F.col("root").alias("node"), "root").distinct())
