"""Queries that judge runs and answers: probes, recoveries, maturation, captures, calendar sums."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions import fields as X
from lodestream.functions import text as T
from lodestream.operators import sequences
from lodestream.plans.registry import query, table

UNITS = ("hour", "day", "week", "month")


@query(" UNION ALL ".join(f"SELECT '{u}' AS unit, CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS started, count(*) AS n, round(sum(value::DECIMAL(28, 2))::DOUBLE, 2) AS total FROM events GROUP BY ALL" for u in UNITS))
def calendar_rollup(spark, sf_dir):
    """Counts and sums by calendar unit: hours are summed first, the greater units from those."""
    hours = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,2)")).alias("total"))
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.date_trunc(u, "hour").alias("started")) for u in UNITS])
    each = hours.select(F.explode(units).alias("u"), "n", "total")
    return each.groupBy("u.unit", "u.started").agg(F.sum("n").alias("n"), F.round(F.sum("total").cast("double"), 2).alias("total"))


@query("""WITH b AS (SELECT conv_id, md5(text) AS block, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations WHERE strlen(text) >= 256 GROUP BY ALL),
e AS (SELECT conv_id, max(turn) AS now FROM conversations GROUP BY conv_id)
SELECT b.conv_id, block, first_turn, last_turn, now - last_turn < 5 AND now - first_turn < 25 AS held FROM b JOIN e ON b.conv_id = e.conv_id""")
def read_maturation(spark, sf_dir):
    """Large blocks that are still held back: touched within five turns and no older than 25."""
    c = table(spark, sf_dir, "conversations")
    blocks = c.where(F.octet_length("text") >= 256).groupBy("conv_id", F.md5(F.col("text").cast("binary")).alias("block")).agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("now"))
    held = (F.col("now") - F.col("last_turn") < 5) & (F.col("now") - F.col("first_turn") < 25)
    return blocks.join(ends, "conv_id").select("conv_id", "block", "first_turn", "last_turn", held.alias("held"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS error_id FROM events)
SELECT event_id, user_id, error_id FROM e WHERE event_type = 'purchase' AND error_id IS NOT NULL""")
def error_recoveries(spark, sf_dir):
    """Successes with the latest error among the five events before them."""
    last = F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(-5, -1))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", last.alias("error_id"))
    return e.where("event_type = 'purchase' AND error_id IS NOT NULL").select("event_id", "user_id", "error_id")


_PROBES = {"numbers": "[0-9]{2,}", "names": "[A-Z][a-z]{5,}", "addresses": r"[a-z]+[.][a-z]+/[a-z0-9/]+"}


@query("""WITH c AS (SELECT text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), p AS ("""
       + " UNION ALL ".join(f"SELECT '{k}' AS dimension, text, unnest(list_distinct(regexp_extract_all(before, '{p}'))) AS fact FROM c" for k, p in _PROBES.items())
       + ") SELECT dimension, count(*) AS facts, count(*) FILTER (contains(text, fact)) AS retained FROM p GROUP BY dimension")
def probe_tallies(spark, sf_dir):
    """How many of one text's facts the next one retains, by kind of fact."""
    c = table(spark, sf_dir, "conversations").select("text", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("before"))
    kinds = F.array(*[F.struct(F.lit(k).alias("dimension"), F.array_distinct(F.regexp_extract_all("before", F.lit(p), F.lit(0))).alias("facts")) for k, p in _PROBES.items()])
    p = c.where("before IS NOT NULL").select("text", F.explode(kinds).alias("k")).select("text", "k.dimension", F.explode("k.facts").alias("fact"))
    return p.groupBy("dimension").agg(F.count(F.lit(1)).alias("facts"), F.count(F.when(F.contains(F.col("text"), F.col("fact")), 1)).alias("retained"))


_CAPTURE = "SELECT user_id, count(*) AS n, sum(value::DECIMAL(28, 2)) AS total FROM events WHERE event_type = '{}' GROUP BY user_id"


@query(f"""WITH a AS ({_CAPTURE.format("view")}), b AS ({_CAPTURE.format("click")})
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.n, 0) - coalesce(a.n, 0) AS n_delta, round((coalesce(b.total, 0) - coalesce(a.total, 0))::DOUBLE, 2) AS total_delta FROM a FULL JOIN b ON a.user_id = b.user_id""")
def capture_diff(spark, sf_dir):
    """Two captures paired by key, with their differences; one pass over the source instead of a join."""
    side = lambda c: F.when(F.col("event_type") == "click", c).when(F.col("event_type") == "view", -c)
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return e.groupBy("user_id").agg(F.sum(side(F.lit(1))).cast("long").alias("n_delta"), F.round(F.sum(side(F.col("value").cast("decimal(28,2)"))).cast("double"), 2).alias("total_delta"))


@query(r"""WITH c AS (SELECT conv_id, turn, lower(trim(text, ' ')) AS t, lag(lower(trim(text, ' '))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
w AS (SELECT conv_id, turn, t, b, regexp_extract_all(t, '[a-z0-9_]+') AS ts, regexp_extract_all(b, '[a-z0-9_]+') AS bs FROM c WHERE b IS NOT NULL),
k AS (SELECT conv_id, turn, x, count(*) FILTER (side = 1) AS n, count(*) FILTER (side = 2) AS m FROM (SELECT conv_id, turn, unnest(ts) AS x, 1 AS side FROM w UNION ALL SELECT conv_id, turn, unnest(bs), 2 FROM w) GROUP BY conv_id, turn, x),
f AS (SELECT conv_id, turn, sum(least(n, m)) AS common FROM k GROUP BY conv_id, turn),
e AS (SELECT w.conv_id, w.turn, regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g') = regexp_replace(b, '[ \t\n\x0B\f\r]+', ' ', 'g') AS exact, contains(t, b) OR contains(b, t) AS contained,
  CASE WHEN len(ts) + len(bs) = 0 THEN 0 ELSE round(2.0::DOUBLE * coalesce(common, 0)::DOUBLE / (len(ts) + len(bs)), 6) END::DOUBLE AS f1 FROM w LEFT JOIN f ON w.conv_id = f.conv_id AND w.turn = f.turn)
SELECT *, exact OR f1 >= 0.7 OR contained AS equivalent FROM e""")
def answer_equivalence(spark, sf_dir):
    """Whether a text says what the one before it says: the same, most of its words, or all of it.

    There is no model here for similarity of meaning; its place among the limbs is left out.
    """
    low = F.trim(F.lower("text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", low.alias("t"), F.lag(low).over(W.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b IS NOT NULL")
    t, b = F.col("t"), F.col("b")
    words = lambda x: F.regexp_extract_all(x, F.lit("[a-z0-9_]+"), F.lit(0))
    count = lambda x, w: F.size(F.filter(x, lambda y: y == w))
    common = F.aggregate(F.array_distinct("ts"), F.lit(0), lambda a, w: a + F.least(count(F.col("ts"), w), count(F.col("bs"), w)))
    c = c.withColumn("ts", words(t)).withColumn("bs", words(b))
    both = F.size("ts") + F.size("bs")
    f1 = F.when(both == 0, 0.0).otherwise(F.round(2.0 * common / both, 6))
    exact, contained = T.normalised(t) == T.normalised(b), F.contains(t, b) | F.contains(b, t)
    return c.select("conv_id", "turn", exact.alias("exact"), contained.alias("contained"), f1.alias("f1")).withColumn("equivalent", F.col("exact") | (F.col("f1") >= 0.7) | F.col("contained"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9]{8,}'), lambda w: regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]')) AS ws FROM documents)
SELECT doc_id, len(list_filter(ws, lambda w: round(-list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: (length(w) - length(replace(w, c, '')))::DOUBLE / length(w) * log2((length(w) - length(replace(w, c, '')))::DOUBLE / length(w)))) / log2(length(w)), 6) >= 0.7)) AS opaque FROM w""")
def opaque_words(spark, sf_dir):
    """How many words of a text look like keys and ids rather than language."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.opaque_words(F.col("text"))).alias("opaque"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type)::DOUBLE / count(*) AS kinds, count(*) FILTER (event_type = 'error') AS errors, stddev_samp(value) AS sd, avg(value) AS m FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN n < 8 THEN 'none' WHEN kinds > 0.8 AND errors = 0 THEN 'skip' WHEN errors > 0.25 * n THEN 'top_n' WHEN sd > m THEN 'smart_sample' ELSE 'cluster' END AS strategy FROM s""")
def strategy_selection(spark, sf_dir):
    """How an array should be cut, by ordered rules on its statistics."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.stddev_samp("value").alias("sd"), F.avg("value").alias("m")
    )
    n, errors = F.col("n"), F.col("errors")
    rule = F.when(n < 8, "none").when((F.col("kinds") / n > 0.8) & (errors == 0), "skip").when(errors > 0.25 * n, "top_n").when(F.col("sd") > F.col("m"), "smart_sample")
    return s.select("user_id", rule.otherwise("cluster").alias("strategy"))


@query("""WITH w AS (SELECT page_id, coalesce(list_sum(list_transform(regexp_extract_all(html, '<!--[^>]*-->'), lambda x: length(x))), 0)::BIGINT AS wasted FROM pages)
SELECT page_id, wasted FROM w ORDER BY wasted DESC, page_id LIMIT 10""")
def top_waste(spark, sf_dir):
    """The ten pages that waste most on comments."""
    return table(spark, sf_dir, "pages").select("page_id", T.waste(F.col("html"))["comments"].alias("wasted")).orderBy(F.desc("wasted"), "page_id").limit(10)


@query()
def rouge_l(spark, sf_dir):
    """Each turn against the one before it by their longest common subsequence of words."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").withColumn("before", before)
    return sequences.rouge_l(c, ["conv_id", "turn"], "text", "before")


@query()
def deflated_sizes(spark, sf_dir):
    return sequences.deflated(table(spark, sf_dir, "documents"), "doc_id", "text")
