"""Arrays of records or strings held as rows (key, position, fields): what they are like, how to cut them, and cutting them.

An array is the rows of one key in the order of a position. Everything is an aggregate or a window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: An ISO date or time at a string's start; seconds and milliseconds that are plausible as timestamps.
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
SECONDS, MILLIS = (1_000_000_000, 2_000_000_000), (1_000_000_000_000, 2_000_000_000_000)
#: Shares that a cut is expected to save, by strategy.
SAVES = {"time_series": 0.7, "cluster": 0.8, "top_n": 0.6, "smart_sample": 0.5, "skip": 0.3}


def numeric_profile(rows: DataFrame, key: str, order: str, field: str, digits: int = 6) -> DataFrame:
    """key, field, n, uniqueness, least, greatest, sequential, id_confidence, score_confidence of a numeric field.

    sequential: at least five values, whose sorted steps are 0.5 to 2 on average and in at least 80 % of cases, and of
    which more than 70 % go up in the array's order.
    """
    x, by = F.col(field), W.partitionBy(key)
    here = rows.where(x.isNotNull())
    here = here.withColumn("__up", (x > F.lag(x).over(by.orderBy(order))).cast("int")).withColumn("__down", (x <= F.lag(x).over(by.orderBy(order))).cast("int"))
    here = here.withColumn("__step", x - F.lag(x).over(by.orderBy(field))).withColumn("__k", F.row_number().over(by.orderBy(order)))
    early = F.col("__k") <= 20
    s = here.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(field).alias("kinds"), F.min(field).alias("least"), F.max(field).alias("greatest"),
        F.avg("__step").alias("step"), F.avg(F.col("__step").between(0.5, 2).cast("int")).alias("small"), F.avg("__up").alias("up"), F.avg("__down").alias("down"),
        F.count(F.when(early & (x != F.floor(x)), 1)).alias("floats"), F.count(F.when(early, 1)).alias("early"),
    )
    uniqueness, n = F.col("kinds") / F.col("n"), F.col("n")
    sequential = F.coalesce((n >= 5) & F.col("step").between(0.5, 2) & (F.col("small") > 0.8) & (F.col("up") > 0.7), F.lit(False))
    spread = F.col("greatest") > F.col("least")
    as_id = F.when(uniqueness < 0.9, 0.0).when(sequential & (uniqueness > 0.95), 0.9).when(spread & (uniqueness > 0.95), 0.85).when(uniqueness > 0.98, 0.7).otherwise(0.0)
    inside = lambda a, b: (F.col("least") >= a) & (F.col("greatest") <= b)
    bounded = F.when(inside(0, 1), 0.4).when(inside(0, 10), 0.3).when(inside(0, 100), 0.25).when(inside(-1, 1), 0.35)
    score = bounded + F.when((n >= 5) & (F.col("down") > 0.7), 0.3).otherwise(0.0) + F.when(F.col("floats") > 0.3 * F.col("early"), 0.1).otherwise(0.0)
    as_score = F.when(bounded.isNull() | sequential | (F.round(score, digits) < 0.4), 0.0).otherwise(F.least(F.round(score, digits), F.lit(0.95)))
    return s.select(key, F.lit(field).alias("field"), "n", F.round(uniqueness, digits).alias("uniqueness"), "least", "greatest", sequential.alias("sequential"), as_id.alias("id_confidence"), as_score.alias("score_confidence"))


def string_profile(rows: DataFrame, key: str, field: str, digits: int = 6) -> DataFrame:
    """key, field, n, uniqueness, kinds, mean_length, iso_share of a string field."""
    s = F.col(field)
    out = rows.where(s.isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(field).alias("kinds"), F.avg(F.length(field)).alias("mean_length"), F.avg(s.rlike(ISO).cast("int")).alias("iso_share")
    )
    return out.select(key, F.lit(field).alias("field"), "n", F.round(F.col("kinds") / F.col("n"), digits).alias("uniqueness"), "kinds", F.round("mean_length", digits).alias("mean_length"), F.round("iso_share", digits).alias("iso_share"))


def pattern(temporal: Column, varies: Column, message: Column, level: Column, score: Column) -> Column:
    """time_series, logs, search_results or generic: the first that applies."""
    return F.when(temporal & varies, "time_series").when(message & level, "logs").when(score >= 0.5, "search_results").otherwise("generic")


def crushability(content: Column, most: Column, has_id: Column, signal: Column) -> Column:
    """Reason of the first rule that applies: content is the uniqueness of what isn't an id, most that of strings and id."""
    return (
        F.when((content < 0.1) & has_id, "repetitive_content_with_ids")
        .when(most < 0.3, "low_uniqueness_safe_to_sample")
        .when(has_id & (most > 0.8) & ~signal, "unique_entities_no_signal")
        .when((most > 0.8) & signal, "unique_entities_with_signal")
        .when(~signal, "medium_uniqueness_no_signal")
        .otherwise("medium_uniqueness_with_signal")
    )


def strategy(n: Column, reason: Column, kind: Column, changes: Column, message_uniqueness: Column, least: int = 5) -> Column:
    skip = reason.endswith("_no_signal")
    return (
        F.when(n < least, "none").when(skip, "skip").when((kind == "time_series") & changes, "time_series")
        .when((kind == "logs") & (message_uniqueness < 0.5), "cluster").when(kind == "search_results", "top_n").otherwise("smart_sample")
    )


def reduction(chosen: Column, constant_share: Column) -> Column:
    base = F.lit(0.0)
    for name, saved in SAVES.items():
        base = F.when(chosen == name, saved).otherwise(base)
    return F.when(chosen == "none", 0.0).otherwise(F.least(base + 0.2 * constant_share, F.lit(0.95)))


def sampled(rows: DataFrame, key: str, order: str, item: str, must: Column, k: int, first: int, last: int, passthrough: int = 8) -> DataFrame:
    """`rows` with why and kept: marked by `must`, first and last of the array, then at even strides what isn't there yet.

    Arrays of up to `passthrough` items stay whole. The stride spreads the places that are left of k; an item equal to
    a kept one, or to one at an earlier stride, adds nothing. Order of the array is by `order`.
    """
    by = W.partitionBy(key)
    x = rows.withColumn("__p", F.row_number().over(by.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(by))
    sure = F.coalesce(must, F.lit(False))
    x = x.withColumn("__sure", sure.cast("int")).withColumn("__kept", sure | (F.col("__p") < first) | (F.col("__p") >= F.col("__n") - last))
    x = x.withColumn("__room", F.greatest(F.lit(k) - F.sum(F.col("__kept").cast("int")).over(by), F.lit(0)))
    x = x.withColumn("__cap", F.lit(k) + F.sum("__sure").over(by) - F.sum(F.col("__kept").cast("int")).over(by))
    stride = F.greatest(F.lit(1), F.floor((F.col("__n") - 1) / (F.col("__room") + 1)))
    at = (F.col("__room") > 0) & ~F.col("__kept") & (F.col("__p") % stride == 0)
    same = W.partitionBy(key, item)
    held = F.max(F.col("__kept").cast("int")).over(same) == 1
    x = x.withColumn("__at", at).withColumn("__held", held)
    earliest = F.min(F.when(F.col("__at"), F.col("__p"))).over(same)
    x = x.withColumn("__new", F.col("__at") & ~F.col("__held") & (F.col("__p") == earliest))
    rank = F.sum(F.col("__new").cast("int")).over(by.orderBy("__p").rowsBetween(W.unboundedPreceding, 0))
    filled = F.col("__new") & (rank <= F.col("__cap"))
    x = x.withColumn("__filled", filled)
    why = F.when(F.col("__n") <= passthrough, "whole").when(F.col("__sure") == 1, "marked").when(F.col("__kept"), "edge").when(F.col("__filled"), "stride").otherwise("dropped")
    return x.withColumn("why", why).withColumn("kept", why != "dropped").select(*rows.columns, "why", "kept")


def strays(field: Column, key: str, sigmas: float = 2.0) -> Column:
    """Whether a value lies more than `sigmas` sample deviations from its array's mean."""
    by = W.partitionBy(key)
    deviation = F.stddev_samp(field).over(by)
    return (deviation > 0) & (F.abs(field - F.avg(field).over(by)) > sigmas * deviation)
