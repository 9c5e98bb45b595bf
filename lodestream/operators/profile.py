"""Statistics over arrays of records held as rows: a group is an array, an order column its positions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.operators.similarity import runs
from lodestream.session import small_batches


def field_statistics(rows: DataFrame, group: str, value: str, digits: int = 4) -> DataFrame:
    """Per group: n, distinct, is_constant, least, greatest, mean, sample variance."""
    x = F.col(value)
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(x).alias("n_distinct"), (F.countDistinct(x) == 1).alias("is_constant"),
        F.min(x).alias("least"), F.max(x).alias("greatest"), F.round(F.avg(x), digits).alias("mean"), F.round(F.var_samp(x), digits).alias("variance"),
    )


def numeric_anomalies(rows: DataFrame, group: str, value: str, sigmas: float = 2.0) -> DataFrame:
    """Rows further than `sigmas` sample deviations from their group's mean; one row a group is joined back."""
    stats = rows.groupBy(group).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    return rows.join(stats, group).where(F.abs(F.col(value) - F.col("__mean")) > sigmas * F.col("__sd")).select(*rows.columns)


def change_candidates(rows: DataFrame, group: str, value: str, order: list[str], window: int = 5, sigmas: float = 2.0) -> DataFrame:
    """rows with pos where the means of the next and the last `window` values differ by over `sigmas` deviations.

    Only positions with a whole window on either side count.
    """
    at = W.partitionBy(group).orderBy(*order)
    before, after = at.rowsBetween(-window, -1), at.rowsBetween(0, window - 1)
    spread = rows.groupBy(group).agg(F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("size"))
    marked = rows.withColumn("pos", F.row_number().over(at) - 1).withColumn("jump", F.avg(value).over(after) - F.avg(value).over(before))
    whole = (F.col("pos") >= window) & (F.col("pos") < F.col("size") - window)
    return marked.join(spread, group).where(whole & (F.abs("jump") > sigmas * F.col("sd"))).select(*rows.columns, "pos")


def change_points(rows: DataFrame, group: str, value: str, order: list[str], window: int = 5, sigmas: float = 2.0) -> DataFrame:
    """group, points: candidates of which one within `window` positions of the last one kept is left out."""
    found = change_candidates(rows, group, value, order, window, sigmas).groupBy(group).agg(F.sort_array(F.collect_list("pos")).alias("at"))
    kept = F.aggregate("at", F.array().cast("array<int>"), lambda out, p: F.when((F.size(out) == 0) | (p - F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) > window), F.array_append(out, p)).otherwise(out))
    return found.select(group, kept.alias("points"))


def top_values(rows: DataFrame, group: str, value: str, order: str, most: int = 5) -> DataFrame:
    """The most frequent values of each group, ties by first appearance."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "first_at"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most)


def number_summary(rows: DataFrame, group: str, value: str, digits: int = 4) -> DataFrame:
    """least, quartiles (linear interpolation), greatest, mean and sample deviation."""
    q = lambda p: F.round(F.percentile(value, F.lit(p)), digits)
    return rows.groupBy(group).agg(F.min(value).alias("least"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.max(value).alias("greatest"), F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_samp(value), digits).alias("deviation"))


def rare_values(rows: DataFrame, fields: list[str], cover: float = 0.8, most_common: int = 5, least_distinct: int = 2, most_distinct: int = 50) -> DataFrame:
    """field, value, n: values outside the smallest prefix by frequency that covers `cover` of a field's rows.

    Fields whose prefix needs more than `most_common` values, or with too few or many values, have none.
    """
    long = rows.unpivot([], fields, "field", "value")
    counted = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("field").orderBy(F.desc("n"), "value")
    whole = W.partitionBy("field")
    counted = counted.select("*", F.sum("n").over(by.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.sum("n").over(whole).alias("total"), F.count(F.lit(1)).over(whole).alias("kinds"))
    counted = counted.withColumn("common", F.coalesce("before", F.lit(0)) < cover * F.col("total"))
    counted = counted.withColumn("prefix", F.sum(F.col("common").cast("int")).over(whole))
    return counted.where(~F.col("common") & (F.col("prefix") <= most_common) & F.col("kinds").between(least_distinct, most_distinct)).select("field", "value", "n")


def rare_keys(rows: DataFrame, id_col: str, document: str, share: float = 0.2) -> DataFrame:
    """id, key of the JSON object keys that fewer than `share` of all rows have."""
    keys = rows.select(id_col, F.explode(F.expr(f"json_object_keys({document})")).alias("key"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    rare = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).where(F.col("n") < share * F.col("total")).select("key")
    return keys.join(rare, "key").select(id_col, "key")


def bigram_curve(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """group, order, total: how many distinct word pairs the group's items have brought so far."""
    words = rows.select(group, order, F.split(F.lower(F.trim(text)), r"\s+").alias("words"))
    first = words.select(group, order, F.explode(runs(F.col("words"), 2, " ")).alias("pair")).groupBy(group, "pair").agg(F.min(order).alias(order))
    new = first.groupBy(group, order).agg(F.count(F.lit(1)).alias("new"))
    return rows.select(group, order).join(new, [group, order], "left").select(group, order, F.sum(F.coalesce("new", F.lit(0))).over(W.partitionBy(group).orderBy(order)).alias("total"))


def knee(curve: DataFrame, group: str, order: str, total: str, least_gain: float = 0.05) -> DataFrame:
    """group, k: items up to where a rising curve departs most from its chord (at least `least_gain`); 1 if flat, null if none."""
    at = W.partitionBy(group)
    y = F.col(total)
    c = curve.select(group, y.alias("__y"), (F.row_number().over(at.orderBy(order)) - 1).alias("i"), F.count(F.lit(1)).over(at).alias("size"), F.min(y).over(at).alias("lo"), F.max(y).over(at).alias("hi"))
    gain = F.round((F.col("__y") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) - F.col("i") / F.nullif(F.col("size") - 1, F.lit(0)), 9)
    best = c.withColumn("gain", gain).groupBy(group).agg(F.max(F.struct("gain", (-F.col("i")).alias("back"))).alias("m"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    k = F.when(F.col("hi") == F.col("lo"), 1).when(F.col("m.gain") >= least_gain, 1 - F.col("m.back"))
    return best.select(group, k.cast("long").alias("k"))


def information_score(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """rows with rarity: the mean over fields of 1 - the share of the row's value within its group."""
    parts = [1 - F.count(F.lit(1)).over(W.partitionBy(group, f)) / F.count(F.lit(1)).over(W.partitionBy(group)) for f in fields]
    return rows.withColumn("rarity", F.round(reduce(Column.__add__, parts) / len(fields), 6))


def importance_counts(rows: DataFrame, text_col: str) -> DataFrame:
    """kind, n: how many lines of all texts are of each kind by `functions.text.importance`, `none` for the others.

    Lines are told by patterns over whole columns; a task hands on four numbers for each batch.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = pc.list_flatten(pc.split_pattern(batch.column("text"), "\n"))
            found = {}
            for kind, listed in T.IMPORTANCE.items():
                told = pc.match_substring_regex(rest, rf"(^|[^a-z0-9_])({'|'.join(listed)})([^a-z0-9_]|$)")
                rest, before = rest.filter(pc.invert(told)), len(rest)
                found[kind] = before - len(rest)
            found["none"] = len(rest)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    small_batches(rows.sparkSession)
    parts = rows.where(F.col(text_col).isNotNull()).select(F.lower(text_col).alias("text")).mapInArrow(count, "kind string, n long")
    return parts.where("n > 0").groupBy("kind").agg(F.sum("n").alias("n"))
