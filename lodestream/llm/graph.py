"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import discard, written


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least v of each u.

    The join is keyed by ~u, so that the planner shuffles both sides for it; adaptive execution can then split the
    partition of a node with very many neighbours, which it can't where an aggregate feeds the join in place.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("key"), "m")
    return edges.select(F.bitwise_not("u").alias("key"), "u", "v").join(least, "key").select("u", "v", "m")


def _stars(edges: DataFrame) -> bool:
    """Whether every node of distinct edges (u, v), v < u, is either the least node of a star or has one edge, to it."""
    end = lambda col, high: F.struct(F.col(col).alias("node"), F.lit(high).alias("high"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("high").alias("highs"), F.min("high").alias("low")).where("highs > 1 or (highs = 1 and low = 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) for every node of an edge table; loops, repeats and nulls don't matter.

    Each round is two joins over at most as many rows as there are edges, written to the shared folder. It ends as
    soon as all edges are stars; rounds are about the logarithm of the longest path. Both directions of an edge and
    both ends of a step come from one scan, so that a round's plan, which the driver holds, stays small.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = written(edges.where(F.col(a) != F.col(b)).select(high, low).distinct(), "edges")
    each = lambda *ways: F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ways])).alias("e")
    while not _stars(now):
        last = now
        both = now.select(each(("u", "v"), ("v", "u"))).select("e.*")
        large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        now = written(_with_least(large).select(each(("v", "m"), ("u", "m"))).select("e.*").where("u != v").distinct(), "edges")
        discard(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
