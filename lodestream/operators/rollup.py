"""Counters, savings and fleet figures over event tables. Relative windows take their anchor from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXACT = "decimal(28,2)"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def successive_deltas(rows: DataFrame, key: str, order: list[str], counter: str) -> DataFrame:
    """rows with delta: the rise of a cumulative counter since the key's row before; resets count as 0, the first as itself."""
    x = F.col(counter).cast(EXACT)
    last = F.lag(x).over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("delta", F.when(last.isNull(), x).otherwise(F.greatest(x - last, F.lit(0).cast(EXACT))))


def rollup(rows: DataFrame, ts: str, bucket: str, value: str, by: list[str] = ()) -> DataFrame:
    """Sums and counts per hour, day, week (from Monday) or month, in UTC."""
    return rows.groupBy(F.date_trunc(bucket, ts).alias("bucket"), *by).agg(F.sum(F.col(value).cast(EXACT)).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


def fleet_totals(rows: DataFrame, instance: str, ts: str, counter: str, bucket: str = "day") -> DataFrame:
    """Greatest counter of each instance and bucket, then their sum and the number of instances by bucket."""
    per = rows.groupBy(instance, F.date_trunc(bucket, ts).alias("bucket")).agg(F.max(F.col(counter).cast(EXACT)).alias("top"))
    return per.groupBy("bucket").agg(F.sum("top").cast("double").alias("total"), F.count(F.lit(1)).alias("instances"))


def fleet_leaders(rows: DataFrame, instance: str, ts: str, counter: str, k: int = 20) -> DataFrame:
    """The k instances of the greatest sum of daily maxima."""
    per = rows.groupBy(instance, F.to_date(ts).alias("day")).agg(F.max(F.col(counter).cast(EXACT)).alias("top"))
    return per.groupBy(instance).agg(F.sum("top").cast("double").alias("total"), F.count(F.lit(1)).alias("days")).orderBy(F.desc("total"), instance).limit(k)


def anchored(rows: DataFrame, ts: str, back: str) -> DataFrame:
    """Rows within an interval before the latest timestamp of all."""
    latest = rows.agg(F.max(ts).alias("__latest"))
    return rows.join(F.broadcast(latest)).where(F.col(ts) >= F.col("__latest") - F.expr(f"INTERVAL {back}")).drop("__latest")


def savings_report(rows: DataFrame, ts: str, value: str, by: list[str]) -> DataFrame:
    """Lifetime, latest day's and last seven days' sums, overall and for each column of `by` apart."""
    latest = rows.agg(F.max(F.to_date(ts)).alias("today"))
    x, day = F.col(value).cast(EXACT), F.to_date(ts)
    part = lambda keep: F.sum(F.when(keep, x).otherwise(F.lit(0).cast(EXACT))).cast("double")
    long = rows.join(F.broadcast(latest)).select("today", ts, value, F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("name")), *[F.struct(F.lit(b).alias("kind"), F.col(b).cast("string").alias("name")) for b in by])).alias("g"))
    return long.groupBy("g.kind", "g.name").agg(F.sum(x).cast("double").alias("lifetime"), part(day == F.col("today")).alias("latest_day"), part(day > F.date_sub("today", 7)).alias("last_week"), F.count(F.lit(1)).alias("n"))


def throughput(rows: DataFrame, by: list[str], rate: Column, digits: int = 4) -> DataFrame:
    q = lambda p: F.round(F.percentile(rate, F.lit(p)), digits)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"))


def session_gaps(rows: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """Per key: how many successive rows are over five minutes, and over an hour, apart."""
    gap = _micros(F.col(ts)) - _micros(F.lag(ts).over(W.partitionBy(key).orderBy(*order)))
    over = lambda s: F.coalesce(F.sum((F.col("gap") > s * 1_000_000).cast("long")), F.lit(0))
    return rows.withColumn("gap", gap).groupBy(key).agg(F.count(F.lit(1)).alias("n"), over(300).alias("over_5m"), over(3600).alias("over_1h"))


def sessions(rows: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions that end after `gap` without a row."""
    return rows.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def miss_attribution(rows: DataFrame, key: str, ts: str, order: list[str], prefix: Column, ttl_seconds: int) -> DataFrame:
    """rows with cause: cold_start, ttl_expiry (before a change of prefix), prefix_change or hit."""
    at = W.partitionBy(key).orderBy(*order)
    out = rows.withColumn("prefix", prefix)
    out = out.withColumn("idle", _micros(F.col(ts)) - _micros(F.lag(ts).over(at))).withColumn("was", F.lag("prefix").over(at))
    cause = F.when(F.col("idle").isNull(), "cold_start").when(F.col("idle") > ttl_seconds * 1_000_000, "ttl_expiry").when(~F.col("was").eqNullSafe(F.col("prefix")), "prefix_change").otherwise("hit")
    return out.withColumn("cause", cause).drop("idle", "was")


def holdout_estimate(rows: DataFrame, stratum: list[str], treated: Column, value: str) -> DataFrame:
    """saved, baseline, variance, percent, low, high from strata that have rows in both arms.

    saved sums n_t (mean_c - mean_t); its variance sums n_t^2 (var_c / n_c + var_t / n_t); the interval is 95 percent.
    """
    x = F.col(value)
    arm = lambda keep, name: [F.count(F.when(keep, x)).alias(f"n{name}"), F.avg(F.when(keep, x)).alias(f"m{name}"), F.coalesce(F.var_samp(F.when(keep, x)), F.lit(0.0)).alias(f"v{name}")]
    per = rows.groupBy(*stratum).agg(*arm(treated, "t"), *arm(~treated, "c")).where("nt > 0 and nc > 0")
    n = F.col("nt")
    total = per.agg(F.sum(n * (F.col("mc") - F.col("mt"))).alias("saved"), F.sum(n * F.col("mc")).alias("baseline"), F.sum(n * n * (F.col("vc") / F.col("nc") + F.col("vt") / n)).alias("variance"), F.sum(n).alias("n"))
    share = lambda c: F.round(F.when(F.col("baseline") > 0, 100 * c / F.col("baseline")).otherwise(0.0), 4)
    half = 1.96 * F.sqrt("variance")
    return total.select(F.col("n"), F.round("saved", 4).alias("saved"), F.round("baseline", 4).alias("baseline"), share(F.col("saved")).alias("percent"), share(F.col("saved") - half).alias("low"), share(F.col("saved") + half).alias("high"))


def with_backoff(rows: DataFrame, baseline: DataFrame, key: list[str], value: str) -> DataFrame:
    """rows with expected: the baseline's mean for the whole key, else for its longest prefix that has one, else for all."""
    out, names = rows, []
    for k in range(len(key), -1, -1):
        level = baseline.groupBy(*key[:k]).agg((F.sum(F.col(value).cast(EXACT)).cast("double") / F.count(value)).alias(f"__m{k}"))
        out = out.join(F.broadcast(level)) if k == 0 else out.join(level, key[:k], "left")
        names.append(f"__m{k}")
    return out.withColumn("expected", F.coalesce(*names)).drop(*names)


def cost(rows: DataFrame, prices: DataFrame, key: str, tokens: str, cached: str) -> DataFrame:
    """Cost per key at prices per million tokens: the cached share of tokens at the cached price."""
    joined = rows.join(F.broadcast(prices), key, "left")
    plain = (F.col(tokens) - F.col(cached)) * F.col("price") + F.col(cached) * F.col("cached_price")
    return joined.groupBy(key).agg(F.sum(tokens).alias("tokens"), F.sum(cached).alias("cached"), F.round(F.sum(plain) / 1e6, 6).alias("cost"))
