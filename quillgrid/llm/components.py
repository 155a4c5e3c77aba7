"""Distributed connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
Every round is a pair of aggregations and joins; only two totals per round
reach the driver. High-degree centres are met by partial aggregation and by
``join_hot``, so no task gets a star's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import join_hot, materialise, release


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(both, least, "u", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` have their greater end in u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    stars = join_hot(edges, least, "u", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stars.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node of its component.

    ``edges`` has long columns u and v; self-loops and repeats are allowed,
    null ends are ignored. An empty input gives an empty result. Rounds go on
    until the edges stay as they are, which the paper shows to happen after
    rounds of the order of log² n at most; no count of rounds cuts them short.
    """
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == was or not state[0]:
            break
        # Every edge gives the large star one, from its greater end.
        before, now = now, materialise(_small_star(_large_star(now, state[0]).filter("u <> v"), state[0]))
        release(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
