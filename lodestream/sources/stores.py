"""Tables that stand for stores: event ledgers in JSON lines, blobs by content, sheets in text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEDGER = "v int, ts string, before long, after long, cost_usd double, model string, client string, source string, _corrupt_record string"


def append_ledger(events: DataFrame, path: str) -> None:
    """Append savings events; columns that are missing are null."""
    wanted = [c.split()[0] for c in LEDGER.split(", ")][:-1]
    events.select(*[F.col(c) if c in events.columns else F.lit(None).alias(c) for c in wanted]).write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Savings events with saved = before - after; malformed lines, unreadable times and rows before `since` are left out."""
    rows = spark.read.schema(LEDGER).option("mode", "PERMISSIVE").json(path)
    rows = rows.withColumn("at", F.try_to_timestamp("ts")).where(F.col("_corrupt_record").isNull() & F.col("at").isNotNull())
    rows = rows.where(F.col("at") >= F.lit(since).cast("timestamp")) if since else rows
    return rows.select("at", "before", "after", (F.col("before") - F.col("after")).alias("saved"), "cost_usd", "model", "client", "source")


def compacted(ledger: DataFrame, ts: str, keep_days: int) -> DataFrame:
    """The rows within `keep_days` of the latest one."""
    latest = ledger.agg(F.max(ts).alias("__latest"))
    return ledger.join(F.broadcast(latest)).where(F.col(ts) >= F.col("__latest") - F.expr(f"INTERVAL {keep_days} DAYS")).drop("__latest")


def blobs(rows: DataFrame, payload: str, created: str, digits: int = 24) -> DataFrame:
    """hash, payload, created_at: one row for each content, the latest time."""
    key = F.substring(F.sha2(F.col(payload).cast("binary"), 256), 1, digits)
    return rows.groupBy(key.alias("hash")).agg(F.first(payload).alias("payload"), F.max(created).alias("created_at"))


def retrieve(store: DataFrame, wanted: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """wanted (hash) with payload, null if unknown or older than the time to live."""
    fresh = store.where(F.unix_micros(F.col("created_at").cast("timestamp")) + ttl_seconds * 1_000_000 > F.unix_micros(now.cast("timestamp")))
    return wanted.join(fresh.select("hash", "payload"), "hash", "left")


def within_capacity(store: DataFrame, capacity: int) -> DataFrame:
    """The latest `capacity` rows, as a sorted limit, which each task cuts before anything is shuffled."""
    return store.orderBy(F.desc("created_at"), "hash").limit(capacity)


def markdown_records(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row, record (map) of pipe tables: a header, a separator, then rows; short rows are padded, long ones cut."""
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|"))
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return _records(rows.select(F.col(id_col).alias("id"), lines.alias("lines")), cells, skip=2)


def delimited_records(rows: DataFrame, id_col: str, text_col: str, delimiter: str = ",") -> DataFrame:
    """id, row, record (map) of delimited text with a header; blank lines are skipped. Cells hold no quoted delimiters."""
    lines = F.filter(F.split(text_col, "\r?\n"), lambda x: F.trim(x) != "")
    cells = lambda line: F.transform(F.split(line, "[" + delimiter + "]"), lambda x: F.trim(x))
    return _records(rows.select(F.col(id_col).alias("id"), lines.alias("lines")), cells, skip=1)


def fixed_width_records(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row, record (map) of columns that two and more spaces part."""
    lines = F.filter(F.split(text_col, "\n"), lambda x: F.trim(x) != "")
    return _records(rows.select(F.col(id_col).alias("id"), lines.alias("lines")), lambda line: F.split(F.trim(line), " {2,}"), skip=1)


def _records(tables: DataFrame, cells, skip: int) -> DataFrame:
    long = tables.where(F.size("lines") > skip).select("id", cells(F.element_at("lines", 1)).alias("header"), F.posexplode(F.slice("lines", skip + 1, F.size("lines"))).alias("row", "line"))
    values = F.transform("header", lambda h, i: F.coalesce(F.get(F.col("cells"), i), F.lit("")))
    return long.withColumn("cells", cells(F.col("line"))).select("id", "row", F.map_from_arrays("header", values).alias("record"))


def key_values(text: Column) -> Column:
    """`a=1 b=2` as a map."""
    return F.str_to_map(text, F.lit(" "), F.lit("="))


def merged_patterns(a: DataFrame, b: DataFrame, key: str, weight: str, means: list[str]) -> DataFrame:
    """Two sets of learned means as one, weighted by their samples."""
    both = a.unionByName(b)
    return both.groupBy(key).agg(F.sum(weight).alias(weight), *[(F.sum(F.col(m) * F.col(weight)) / F.sum(weight)).alias(m) for m in means])


def versions(rows: DataFrame, key: list[str], order: list[str], until: str, start: str) -> DataFrame:
    """rows with `until`, the start of the key's next version, and is_current."""
    by = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn(until, F.lead(start).over(by)).withColumn("is_current", F.lead(start).over(by).isNull())
