"""Selection under a budget: flags for what must stay, ranks for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def k_split(k: Column, first_share: float = 0.3, last_share: float = 0.15) -> tuple[Column, Column, Column]:
    """How many of k go to the first items, the last ones and to importance; halves round to even, each at least 1."""
    first = F.greatest(F.lit(1), F.bround(k * first_share).cast("int"))
    last = F.greatest(F.lit(1), F.bround(k * last_share).cast("int"))
    return first, last, F.greatest(F.lit(0), k - first - last)


def edges(rows: DataFrame, group: str, order: list[str], first: int, last: int) -> DataFrame:
    """rows with pos and is_edge: among the first or last of their group."""
    up = W.partitionBy(group).orderBy(*order)
    size = F.count(F.lit(1)).over(W.partitionBy(group))
    out = rows.withColumn("pos", F.row_number().over(up) - 1)
    return out.withColumn("is_edge", (F.col("pos") < first) | (F.col("pos") >= size - last))


def budgeted(rows: DataFrame, group: str, must: Column, priority: list[Column], k: int) -> DataFrame:
    """Rows that must stay, whatever k, and others by priority while fewer than k are kept in the group."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(must.desc(), *priority))
    return rows.withColumn("__rank", rank).where(must | (F.col("__rank") <= k)).drop("__rank")


def top_per_group(rows: DataFrame, group: str, by: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*by))).where(F.col("rank") <= k)


def first_of_clusters(rows: DataFrame, group: str, cluster: Column, order: list[str], k: int = 2) -> DataFrame:
    """At most k rows of each cluster, in order."""
    n = F.row_number().over(W.partitionBy(group, "cluster").orderBy(*order))
    return rows.withColumn("cluster", cluster).withColumn("nth", n).where(F.col("nth") <= k)


def strided(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """About k rows of each group at even steps from its first."""
    pos = F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(W.partitionBy(group)) / (k + 1)))
    return rows.withColumn("pos", pos).withColumn("step", step).where((F.col("pos") % F.col("step") == 0) & (F.col("pos") / F.col("step") < k)).drop("step")


def thinned(rows: DataFrame, group: str, order: list[str], dense: int, sampled: int) -> DataFrame:
    """History down-sampling: the last `dense` rows of a group and about `sampled` of the older ones at even steps."""
    up = W.partitionBy(group).orderBy(*order)
    size = F.count(F.lit(1)).over(W.partitionBy(group))
    out = rows.withColumn("pos", F.row_number().over(up) - 1).withColumn("older", size - dense)
    step = F.greatest(F.lit(1), F.ceil(F.col("older") / sampled))
    return out.where((F.col("pos") >= F.col("older")) | (F.col("pos") % step == 0)).drop("older")


def within_tokens(rows: DataFrame, group: str, tokens: str, by: list[Column], budget: int) -> DataFrame:
    """The longest prefix by priority whose tokens fit the budget, with the running total."""
    used = F.sum(tokens).over(W.partitionBy(group).orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= budget)


def dropped(rows: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(kept.select(*key).distinct(), key, "left_anti")
