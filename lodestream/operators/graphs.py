"""Graph walks over edge tables, a bounded number of joins each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, source: str = "src", target: str = "dst") -> DataFrame:
    """node, depth: every node within `hops` edges of a seed, either way, at its least depth. Each hop reads the last one once."""
    both = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).union(edges.select(target, source))
    reached = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0))
    here, there = F.struct("node", "depth"), F.struct(F.col("v").alias("node"), (F.col("depth") + 1).alias("depth"))
    for _ in range(hops):
        steps = reached.join(both, F.col("node") == F.col("u"), "left")
        steps = steps.select(F.explode(F.when(F.col("u").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("s")).select("s.*")
        reached = steps.groupBy("node").agg(F.min("depth").alias("depth"))
    return reached


def touched_edges(edges: DataFrame, nodes: DataFrame, hops: int, source: str = "src", target: str = "dst") -> DataFrame:
    """Edges of the nodes that a walk of `hops` expands, whether their other end is known or not."""
    inner = nodes.where(F.col("depth") < hops).select("node")
    out = edges.join(inner.withColumnRenamed("node", source), source, "left_semi")
    return out.union(edges.join(inner.withColumnRenamed("node", target), target, "left_semi").select(*out.columns)).distinct()


def shortest_paths(edges: DataFrame, start, most: int, source: str = "src", target: str = "dst") -> DataFrame:
    """node, depth, path: one shortest directed path from `start` to each node within `most` edges, the least by text."""
    e = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).distinct()
    reached = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("depth"), F.lit(str(start)).alias("path"))
    frontier = reached
    for depth in range(1, most + 1):
        step = frontier.join(e, F.col("node") == F.col("u")).groupBy("v").agg(F.min(F.concat_ws(">", "path", F.col("v").cast("string"))).alias("path"))
        frontier = step.select(F.col("v").alias("node"), F.lit(depth).alias("depth"), "path").join(reached, "node", "left_anti")
        reached = reached.union(frontier)
    return reached


def history(links: DataFrame, start: DataFrame, most: int, id_col: str, before_col: str) -> DataFrame:
    """root, id, age: the chain of versions behind each start, by following `before_col` at most `most` times."""
    now = start.select(F.col(id_col).alias("root"), F.col(id_col).alias("id")).withColumn("age", F.lit(0))
    back = links.select(F.col(id_col).alias("id"), F.col(before_col).alias("before")).where(F.col("before").isNotNull())
    out = now
    for age in range(1, most + 1):
        now = now.join(back, "id").select("root", F.col("before").alias("id"), F.lit(age).alias("age"))
        out = out.union(now)
    return out
