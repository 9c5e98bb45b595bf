"""Streaming forms: event-time windows with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling(rows: DataFrame, ts: str, by: list[str], value: str, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums by window of event time; rows later than `late` are left out. `slide` makes windows overlap."""
    when = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = rows.withWatermark(ts, late).groupBy(when.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(28,2)")).cast("double").alias("total"))
    return out.select(F.col("w.start").alias("started"), *by, "n", "total")


def sessions(rows: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    out = rows.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def token_bucket(rows: DataFrame, key: str, ts: str, rate_per_minute: float, capacity: float, idle: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """key, ts, allowed, wait_seconds: requests against a bucket a key that refills with event time.

    State is two numbers a key; keys without a request for `idle` of event time, behind the watermark, lose it.
    """
    kind = rows.schema[key].dataType.simpleString()
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        for frame in frames:
            out = []
            for at in sorted(frame[ts]):
                seconds = at.timestamp()
                if last is not None:
                    tokens = min(capacity, tokens + max(0.0, seconds - last) * rate_per_minute / 60)
                last = seconds if last is None else max(last, seconds)
                ok = tokens >= 1
                tokens -= ok
                out.append((k[0], at, bool(ok), 0.0 if ok else (1 - tokens) * 60 / rate_per_minute))
            yield pd.DataFrame(out, columns=[key, ts, "allowed", "wait_seconds"])
        state.update((float(tokens), last))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + idle_ms)

    schema = f"{key} {kind}, {ts} timestamp, allowed boolean, wait_seconds double"
    return rows.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, schema, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def drift(rows: DataFrame, key: str, ts: str, structure: str) -> DataFrame:
    """key, ts, changed: whether a row's structure hash differs from that of the key's row before."""
    kind = rows.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            out = []
            for at, now in frame.sort_values(ts)[[ts, structure]].itertuples(index=False):
                out.append((k[0], at, last is not None and now != last))
                last = now
            yield pd.DataFrame(out, columns=[key, ts, "changed"])
        state.update((last,))

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, changed boolean", "last string", "append", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is and give its result; for tests and backfills."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
