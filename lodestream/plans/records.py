"""Queries over event and order records: profiles, selection, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators import profile, rollup, selection
from lodestream.plans.registry import query, table

TIMELINE = ["ts", "event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT value) AS n_distinct, count(DISTINCT value) = 1 AS is_constant, min(value) AS least,
  max(value) AS greatest, round(avg(value), 4) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY event_type""")
def field_statistics(spark, sf_dir):
    return profile.field_statistics(_events(spark, sf_dir), "event_type", "value")


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY event_type)
SELECT event_id, e.event_type, value FROM events e JOIN s ON e.event_type = s.event_type WHERE abs(value - m) > 2 * sd""")
def numeric_anomalies(spark, sf_dir):
    return profile.numeric_anomalies(_events(spark, sf_dir).select("event_id", "event_type", "value"), "event_type", "value")


_CHANGES = """WITH s AS (SELECT user_id, stddev_samp(value) AS sd, count(*) AS size FROM events GROUP BY user_id),
w AS (SELECT event_id, user_id, row_number() OVER p - 1 AS pos, avg(value) OVER (p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) - avg(value) OVER (p ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS jump
  FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT event_id, w.user_id, pos FROM w JOIN s ON w.user_id = s.user_id WHERE pos >= 5 AND pos < size - 5 AND abs(jump) > 1.0 * sd)"""


@query(_CHANGES + " SELECT event_id, user_id, pos FROM c")
def change_candidates(spark, sf_dir):
    return profile.change_candidates(_events(spark, sf_dir), "user_id", "value", TIMELINE, sigmas=1.0).select("event_id", "user_id", "pos")


@query(_CHANGES.replace("WITH s", "WITH RECURSIVE s") + """,
k AS (SELECT user_id, min(pos) AS pos FROM c GROUP BY user_id UNION ALL
  SELECT user_id, pos FROM (SELECT c.user_id, min(c.pos) AS pos FROM k JOIN c ON c.user_id = k.user_id AND c.pos - k.pos > 5 GROUP BY c.user_id, k.pos))
SELECT user_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS points FROM (SELECT DISTINCT user_id, pos FROM k) GROUP BY user_id""")
def change_points(spark, sf_dir):
    out = profile.change_points(_events(spark, sf_dir), "user_id", "value", TIMELINE, sigmas=1.0)
    return out.select("user_id", F.array_join(F.col("points").cast("array<string>"), ",").alias("points"))


@query("""WITH c AS (SELECT event_type, props, count(*) AS n, min(event_id) AS first_at FROM events WHERE props IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, first_at) AS rank FROM c) WHERE rank <= 5""")
def top_values(spark, sf_dir):
    return profile.top_values(_events(spark, sf_dir), "event_type", "props", "event_id")


@query("""SELECT event_type, min(value) AS least, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS median,
  round(quantile_cont(value, 0.75), 4) AS p75, max(value) AS greatest, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS deviation
  FROM events GROUP BY event_type""")
def number_summary(spark, sf_dir):
    return profile.number_summary(_events(spark, sf_dir), "event_type", "value")


@query("""WITH l AS (UNPIVOT (SELECT o_orderstatus, o_orderpriority FROM orders) ON o_orderstatus, o_orderpriority INTO NAME field VALUE value),
c AS (SELECT field, value, count(*) AS n FROM l GROUP BY ALL),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY field ORDER BY n DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
  sum(n) OVER (PARTITION BY field) AS t, count(*) OVER (PARTITION BY field) AS kinds FROM c),
p AS (SELECT *, sum((b < 0.8 * t)::INT) OVER (PARTITION BY field) AS prefix FROM w)
SELECT field, value, n FROM p WHERE b >= 0.8 * t AND prefix <= 5 AND kinds BETWEEN 2 AND 50""")
def rare_status_values(spark, sf_dir):
    return profile.rare_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key FROM events),
r AS (SELECT key FROM k GROUP BY key HAVING count(*) < 0.2 * (SELECT count(*) FROM events))
SELECT event_id, key FROM k WHERE key IN (SELECT key FROM r)""")
def structural_outliers(spark, sf_dir):
    return profile.rare_keys(_events(spark, sf_dir), "event_id", "props")


_CURVE = """WITH w AS (SELECT conv_id, turn, regexp_split_to_array(lower(trim(text, ' ')), '[ \\t\\n\\x0B\\f\\r]+') AS ws FROM conversations),
p AS (SELECT conv_id, turn, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS pair FROM w),
f AS (SELECT conv_id, pair, min(turn) AS turn FROM p GROUP BY ALL), n AS (SELECT conv_id, turn, count(*) AS new FROM f GROUP BY ALL),
c AS (SELECT w.conv_id, w.turn, sum(coalesce(new, 0)) OVER (PARTITION BY w.conv_id ORDER BY w.turn)::BIGINT AS total
  FROM w LEFT JOIN n ON w.conv_id = n.conv_id AND w.turn = n.turn)"""


@query(_CURVE + " SELECT conv_id, turn, total FROM c")
def unique_bigram_curve(spark, sf_dir):
    return profile.bigram_curve(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(_CURVE + """, x AS (SELECT conv_id, total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  min(total) OVER (PARTITION BY conv_id) AS lo, max(total) OVER (PARTITION BY conv_id) AS hi FROM c),
g AS (SELECT *, round((total - lo) / nullif(hi - lo, 0) - i / nullif(n - 1, 0), 9) AS gain FROM x)
SELECT conv_id, CASE WHEN max(hi) = min(lo) THEN 1 WHEN max(gain) >= 0.05 THEN 1 + min(i) FILTER (WHERE gain = mg) END AS k
FROM (SELECT *, max(gain) OVER (PARTITION BY conv_id) AS mg FROM g) GROUP BY conv_id""")
def kneedle(spark, sf_dir):
    return profile.knee(unique_bigram_curve(spark, sf_dir), "conv_id", "turn", "total")


@query("""SELECT event_id, round((2 - (count(*) OVER (PARTITION BY user_id, event_type))::DOUBLE / count(*) OVER (PARTITION BY user_id)
  - (count(*) OVER (PARTITION BY user_id, props))::DOUBLE / count(*) OVER (PARTITION BY user_id)) / 2, 6) AS rarity FROM events""")
def information_score(spark, sf_dir):
    return profile.information_score(_events(spark, sf_dir), "user_id", ["event_type", "props"]).select("event_id", "rarity")


@query("""WITH n AS (SELECT user_id, count(*) AS k FROM events GROUP BY user_id)
SELECT user_id, k, greatest(1, CASE WHEN k * 0.3 % 1 = 0.5 THEN 2 * round(k * 0.3 / 2) ELSE round(k * 0.3) END)::INT AS first_k,
  greatest(1, CASE WHEN k * 0.15 % 1 = 0.5 THEN 2 * round(k * 0.15 / 2) ELSE round(k * 0.15) END)::INT AS last_k FROM n""")
def k_split(spark, sf_dir):
    first, last, _ = selection.k_split(F.col("k"))
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("k")).select("user_id", "k", first.alias("first_k"), last.alias("last_k"))


@query("""WITH e AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS size, avg(value) OVER (PARTITION BY event_type) AS m,
  stddev_samp(value) OVER (PARTITION BY event_type) AS sd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, event_type = 'error' OR abs(value - m) > 2 * sd AS must, pos < 3 OR pos >= size - 2 AS edge FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY must DESC, edge DESC, pos) AS rank FROM f)
SELECT event_id, user_id, pos FROM r WHERE must OR rank <= 15""")
def priority_budget(spark, sf_dir):
    events = selection.edges(_events(spark, sf_dir), "user_id", TIMELINE, 3, 2)
    stats = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    must = (F.col("event_type") == "error") | (F.abs(F.col("value") - F.col("m")) > 2 * F.col("sd"))
    kept = selection.budgeted(events.join(stats, "event_type"), "user_id", must, [F.col("is_edge").desc(), F.col("pos")], 15)
    return kept.select("event_id", "user_id", "pos")


@query("""SELECT event_id, user_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5""")
def top_n_by_score(spark, sf_dir):
    return selection.top_per_group(_events(spark, sf_dir), "user_id", [F.desc("value"), F.col("event_id")], 5).select("event_id", "user_id", "value", "rank")


@query("""WITH c AS (SELECT event_id, user_id, substr(md5(event_type || props), 1, 2) AS cluster, ts FROM events)
SELECT event_id, cluster, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cluster ORDER BY ts, event_id) AS nth FROM c) WHERE nth <= 2""")
def cluster_sample(spark, sf_dir):
    cluster = F.substring(F.md5(F.concat("event_type", "props")), 1, 2)
    return selection.first_of_clusters(_events(spark, sf_dir), "user_id", cluster, TIMELINE).select("event_id", "cluster", "nth")


@query("""WITH e AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, greatest(1, count(*) OVER (PARTITION BY user_id) // 11) AS step FROM events)
SELECT event_id, pos FROM e WHERE pos % step = 0 AND pos / step < 10""")
def strided_sample(spark, sf_dir):
    return selection.strided(_events(spark, sf_dir), "user_id", TIMELINE, 10).select("event_id", "pos")


@query("""WITH e AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) - 20 AS older FROM events)
SELECT event_id, pos FROM e WHERE pos >= older OR pos % greatest(1, ceil(older / 10)::BIGINT) = 0""")
def history_thinning(spark, sf_dir):
    return selection.thinned(_events(spark, sf_dir), "user_id", TIMELINE, 20, 10).select("event_id", "pos")


@query("""WITH e AS (SELECT event_id, user_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM events)
SELECT event_id, used FROM e WHERE used <= 100""")
def token_budget(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("tokens", F.length("props"))
    return selection.within_tokens(events, "user_id", "tokens", [F.desc("value"), F.col("event_id")], 100).select("event_id", "used")


@query("""WITH k AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5)
SELECT user_id, count(*) AS n_dropped FROM events WHERE event_id NOT IN (SELECT event_id FROM k) GROUP BY user_id""")
def dropped_items(spark, sf_dir):
    events = _events(spark, sf_dir)
    kept = selection.top_per_group(events, "user_id", [F.desc("value"), F.col("event_id")], 5)
    return selection.dropped(events, kept, ["event_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_dropped"))


_DELTAS = """WITH d AS (SELECT *, greatest(value::DECIMAL(28, 2) - coalesce(lag(value::DECIMAL(28, 2)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 0) AS delta FROM events)"""


@query(_DELTAS + " SELECT event_id, delta::DOUBLE AS delta FROM d")
def successive_delta(spark, sf_dir):
    return rollup.successive_deltas(_events(spark, sf_dir), "user_id", TIMELINE, "value").select("event_id", F.col("delta").cast("double").alias("delta"))


@query(" UNION ALL ".join(f"{_DELTAS if k == 0 else ''} SELECT '{b}' AS span, date_trunc('{b}', ts)::TIMESTAMP AS bucket, event_type, sum(delta)::DOUBLE AS total, count(*) AS n FROM d GROUP BY ALL" for k, b in enumerate(("hour", "day", "week", "month"))))
def counter_rollup(spark, sf_dir):
    rows = rollup.successive_deltas(_events(spark, sf_dir), "user_id", TIMELINE, "value")
    spans = [rollup.rollup(rows, "ts", b, "delta", ["event_type"]).withColumn("span", F.lit(b)) for b in ("hour", "day", "week", "month")]
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


@query("""WITH p AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS bucket, max(value::DECIMAL(28, 2)) AS top FROM events GROUP BY ALL)
SELECT bucket, sum(top)::DOUBLE AS total, count(*) AS instances FROM p GROUP BY bucket""")
def fleet_daily(spark, sf_dir):
    return rollup.fleet_totals(_events(spark, sf_dir), "user_id", "ts", "value")


@query("""WITH p AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS bucket, max(value::DECIMAL(28, 2)) AS top FROM events
  WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOURS GROUP BY ALL)
SELECT bucket, sum(top)::DOUBLE AS total, count(*) AS instances FROM p GROUP BY bucket""")
def fleet_hourly(spark, sf_dir):
    return rollup.fleet_totals(rollup.anchored(_events(spark, sf_dir), "ts", "48 HOURS"), "user_id", "ts", "value", "hour")


@query("""WITH p AS (SELECT user_id, ts::DATE AS day, max(value::DECIMAL(28, 2)) AS top FROM events GROUP BY ALL)
SELECT user_id, sum(top)::DOUBLE AS total, count(*) AS days FROM p GROUP BY user_id ORDER BY sum(top) DESC, user_id LIMIT 20""")
def fleet_leaders(spark, sf_dir):
    return rollup.fleet_leaders(_events(spark, sf_dir), "user_id", "ts", "value")


@query("""WITH c AS (SELECT event_type, user_id % 3 AS version, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, string_agg(version || ':' || n, ',' ORDER BY version) AS by_version FROM c GROUP BY event_type""")
def breakdown_by_version(spark, sf_dir):
    c = _events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 3).alias("version")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("version", F.concat_ws(":", "version", "n").alias("s"))))
    return c.groupBy("event_type").agg(F.array_join(F.transform(pairs, lambda p: p["s"]), ",").alias("by_version"))


@query("""WITH t AS (SELECT max(ts::DATE) AS today FROM events), g AS (SELECT 'all' AS kind, '' AS name, ts, value FROM events UNION ALL SELECT 'event_type', event_type, ts, value FROM events
  UNION ALL SELECT 'user_id', user_id::VARCHAR, ts, value FROM events)
SELECT kind, name, sum(value::DECIMAL(28, 2))::DOUBLE AS lifetime, sum(CASE WHEN ts::DATE = today THEN value::DECIMAL(28, 2) ELSE 0 END)::DOUBLE AS latest_day,
  sum(CASE WHEN ts::DATE > today - 7 THEN value::DECIMAL(28, 2) ELSE 0 END)::DOUBLE AS last_week, count(*) AS n FROM g, t GROUP BY ALL""")
def savings_report(spark, sf_dir):
    return rollup.savings_report(_events(spark, sf_dir), "ts", "value", ["event_type", "user_id"])


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value / 10, 0.5), 4) AS p50, round(quantile_cont(value / 10, 0.95), 4) AS p95 FROM events
  WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAYS GROUP BY event_type""")
def trailing_throughput(spark, sf_dir):
    return rollup.throughput(rollup.anchored(_events(spark, sf_dir), "ts", "5 DAYS"), ["event_type"], F.col("value") / 10)


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT user_id, count(*) AS n, coalesce(sum((gap > 300000000)::INT), 0)::BIGINT AS over_5m, coalesce(sum((gap > 3600000000)::INT), 0)::BIGINT AS over_1h FROM g GROUP BY user_id""")
def session_gaps(spark, sf_dir):
    return rollup.session_gaps(_events(spark, sf_dir), "user_id", "ts", TIMELINE)


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS, true)::INT AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS started, (max(ts) + INTERVAL 6 HOURS)::TIMESTAMP AS ended, count(*) AS n FROM s GROUP BY user_id, s""")
def sessions(spark, sf_dir):
    return rollup.sessions(_events(spark, sf_dir), "user_id", "ts", "6 hours")


@query("""WITH w AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER p) AS idle, lag(event_type) OVER p AS was FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN idle IS NULL THEN 'cold_start' WHEN idle > 3600000000 THEN 'ttl_expiry' WHEN was IS DISTINCT FROM event_type THEN 'prefix_change' ELSE 'hit' END AS cause FROM w""")
def miss_attribution(spark, sf_dir):
    return rollup.miss_attribution(_events(spark, sf_dir), "user_id", "ts", TIMELINE, F.col("event_type"), 3600).select("event_id", "cause")


@query("""WITH e AS (SELECT event_type, value, ('0x' || substr(sha256('arm:' || user_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE >= 0.3 AS treated FROM events),
s AS (SELECT event_type, count(*) FILTER (treated) AS nt, count(*) FILTER (NOT treated) AS nc, avg(value) FILTER (treated) AS mt, avg(value) FILTER (NOT treated) AS mc,
  coalesce(var_samp(value) FILTER (treated), 0) AS vt, coalesce(var_samp(value) FILTER (NOT treated), 0) AS vc FROM e GROUP BY event_type HAVING nt > 0 AND nc > 0),
t AS (SELECT sum(nt * (mc - mt)) AS saved, sum(nt * mc) AS baseline, sum(nt::DOUBLE * nt * (vc / nc + vt / nt)) AS variance, sum(nt)::BIGINT AS n FROM s)
SELECT n, round(saved, 4) AS saved, round(baseline, 4) AS baseline, round(100 * saved / baseline, 4) AS percent, round(100 * (saved - 1.96::DOUBLE * sqrt(variance)) / baseline, 4) AS low,
  round(100 * (saved + 1.96::DOUBLE * sqrt(variance)) / baseline, 4) AS high FROM t""")
def holdout_estimate(spark, sf_dir):
    arm = F.conv(F.substring(F.sha2(F.concat(F.lit("arm:"), F.col("user_id").cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    events = _events(spark, sf_dir).withColumn("treated", arm >= 0.3)
    return rollup.holdout_estimate(events, ["event_type"], F.col("treated"), "value")


@query("""WITH x AS (SELECT *, coalesce(user_id, 0) % 2 = 0 AS even FROM events),
k2 AS (SELECT NOT even AS even, event_type, props, sum(value::DECIMAL(28, 2))::DOUBLE / count(value) AS m FROM x GROUP BY ALL),
k1 AS (SELECT NOT even AS even, event_type, sum(value::DECIMAL(28, 2))::DOUBLE / count(value) AS m FROM x GROUP BY ALL),
k0 AS (SELECT NOT even AS even, sum(value::DECIMAL(28, 2))::DOUBLE / count(value) AS m FROM x GROUP BY ALL)
SELECT event_id, coalesce(k2.m, k1.m, k0.m) AS expected FROM x LEFT JOIN k2 USING (even, event_type, props) LEFT JOIN k1 USING (even, event_type) LEFT JOIN k0 USING (even)""")
def baseline_backoff(spark, sf_dir):
    """Each event beside what the other half of the users leads to expect; events without a user count as even."""
    events = _events(spark, sf_dir)
    even = F.coalesce("user_id", F.lit(0)) % 2 == 0
    halves = [rollup.with_backoff(events.where(rows), events.where(~rows), ["event_type", "props"], "value") for rows in (even, ~even)]
    return halves[0].unionByName(halves[1]).select("event_id", "expected")


@query("""WITH p(l_shipmode, price, cached_price) AS (VALUES ('A', 3.0::DOUBLE, 0.3::DOUBLE), ('N', 15.0::DOUBLE, 1.5::DOUBLE))
SELECT l_returnflag AS model, sum(l_quantity) AS tokens, sum(l_linenumber)::BIGINT AS cached, round(sum((l_quantity - l_linenumber) * price + l_linenumber * cached_price) / 1000000, 6) AS cost
FROM lineitem LEFT JOIN p ON l_returnflag = l_shipmode GROUP BY l_returnflag""")
def cost_by_model(spark, sf_dir):
    prices = spark.createDataFrame([("A", 3.0, 0.3), ("N", 15.0, 1.5)], "model string, price double, cached_price double")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("tokens"), F.col("l_linenumber").alias("cached"))
    return rollup.cost(rows, prices, "model", "tokens", "cached")


@query("""SELECT o_orderstatus AS mode, count(*) AS n, sum(o_totalprice::DECIMAL(28, 2))::DOUBLE AS total, round(avg(o_totalprice), 2) AS mean,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY ALL""")
def metrics_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderstatus").alias("mode")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast(rollup.EXACT)).cast("double").alias("total"), F.round(F.avg("o_totalprice"), 2).alias("mean"),
        F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("urgent"),
    )


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'
  ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10""")
def metrics_page(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01") & (F.col("o_orderstatus") == "F"))
    return orders.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate").offset(10).limit(50)


@query("""SELECT bucket, count(*) AS n FROM (SELECT least(9, floor(l_discount * 100))::BIGINT AS bucket FROM lineitem) GROUP BY bucket""")
def hit_rate_histogram(spark, sf_dir):
    bucket = F.least(F.lit(9), F.floor(F.col("l_discount") * 100)).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT user_id, event_type || props AS signature, count(*) AS n, sum(length(props)) AS bytes, max(length(props)) AS largest FROM events GROUP BY ALL HAVING n >= 3)
SELECT signature, count(*) AS sessions, sum(n)::BIGINT AS repeats, sum((bytes - largest) // 4)::BIGINT AS wasted FROM r GROUP BY signature""")
def loop_detection(spark, sf_dir):
    per = _events(spark, sf_dir).groupBy("user_id", F.concat("event_type", "props").alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("props")).alias("bytes"), F.max(F.length("props")).alias("largest")).where("n >= 3")
    return per.groupBy("signature").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("repeats"), F.sum(F.expr("(bytes - largest) div 4")).alias("wasted"))


@query("""WITH v AS (SELECT event_id, user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_until,
  lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded_by FROM events)
SELECT event_id, valid_until::TIMESTAMP AS valid_until, superseded_by, superseded_by IS NULL AS is_current FROM v""")
def supersession(spark, sf_dir):
    by = W.partitionBy("user_id", "event_type").orderBy(*TIMELINE)
    out = _events(spark, sf_dir).withColumn("valid_until", F.lead("ts").over(by)).withColumn("superseded_by", F.lead("event_id").over(by))
    return out.select("event_id", "valid_until", "superseded_by", F.col("superseded_by").isNull().alias("is_current"))


@query("""WITH s AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, avg((value > 20)::INT) AS rate FROM events GROUP BY event_type)
SELECT event_type, CASE WHEN n < 5 THEN 15 WHEN rate > 0.5 THEN 50 WHEN rate > 0.2 THEN 30 ELSE 15 END AS max_items,
  round(least(0.95, least(0.7, n / 100) + least(0.3, 0.03 * users)), 4)::DOUBLE AS confidence FROM s""")
def compression_hints(spark, sf_dir):
    s = _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.avg((F.col("value") > 20).cast("int")).alias("rate"))
    items = F.when(F.col("n") < 5, 15).when(F.col("rate") > 0.5, 50).when(F.col("rate") > 0.2, 30).otherwise(15)
    sure = F.least(F.lit(0.95), F.least(F.lit(0.7), F.col("n") / 100) + F.least(F.lit(0.3), 0.03 * F.col("users")))
    return s.select("event_type", items.alias("max_items"), F.round(sure, 4).alias("confidence"))
