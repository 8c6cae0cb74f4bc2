"""Distributed union-find: alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v: two longs); component: the smallest node it reaches.

    Nodes without an edge don't occur in the result; self-loops and nulls count as no edge. Each round is three
    aggregations or joins on the node, and is written to the shared folder, so that a lost executor costs one round
    at most. Rounds grow with the logarithm of the number of nodes. A hub's edges are joined, never gathered in a row.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(before, large, shuffles=False)
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError("components: no fixed point")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
