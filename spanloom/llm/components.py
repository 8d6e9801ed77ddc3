"""Connected components by alternating large and small stars, in plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _starred(pairs: DataFrame, larger: bool) -> DataFrame:
    """For every u, its chosen neighbours and itself are tied to the smallest of them all."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    rows = pairs.join(least.hint("merge"), "u")
    if larger:
        return rows.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    tied = rows.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b")


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node of an edge table
    (``a``, ``b``) that is not its own root.

    A round costs a constant number of exchanges and their number grows with the logarithm
    of the largest distance.  Minima are combined before the exchange and joins of a hub are
    split by AQE.  Each round is written to the shared folder, so a lost executor costs one
    round at most.  An empty table gives an empty one; loops and repeated edges are fine."""
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
    before = state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = _starred(_both(e), True).distinct()
        small = _starred(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v"), False)
        e = written(small.distinct(), "edges")
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
