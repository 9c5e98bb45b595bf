"""Queries over arrays: profiles of fields, the decision how to cut, samplers, markers of what was dropped."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators import arrays
from lodestream.plans.registry import query, table

_NUMERIC = """SELECT user_id, '{0}' AS field, count(*) AS n, count(DISTINCT x)::DOUBLE / count(*) AS u, min(x)::DOUBLE AS least, max(x)::DOUBLE AS greatest,
  count(*) >= 5 AND avg(step) BETWEEN 0.5 AND 2 AND avg((step BETWEEN 0.5 AND 2)::INT) > 0.8 AND avg(up::INT) > 0.7 AS seq, avg((NOT up)::INT) AS down,
  count(*) FILTER (k <= 20 AND x <> floor(x)) AS floats, count(*) FILTER (k <= 20) AS early
  FROM (SELECT user_id, {0} AS x, {0} > lag({0}) OVER o AS up, {0} - lag({0}) OVER (PARTITION BY user_id ORDER BY {0}) AS step, row_number() OVER o AS k FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id"""
_PROFILES = f"""s AS ({_NUMERIC.format("event_id")} UNION ALL {_NUMERIC.format("value")}),
b AS (SELECT *, CASE WHEN least >= 0 AND greatest <= 1 THEN 0.4 WHEN least >= 0 AND greatest <= 10 THEN 0.3 WHEN least >= 0 AND greatest <= 100 THEN 0.25 WHEN least >= -1 AND greatest <= 1 THEN 0.35 END::DOUBLE AS bounded FROM s),
c AS (SELECT *, round(bounded + CASE WHEN n >= 5 AND down > 0.7 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN floats > 0.3 * early THEN 0.1::DOUBLE ELSE 0 END, 6) AS score FROM b),
f AS (SELECT user_id, field, n, round(u, 6) AS uniqueness, least, greatest, coalesce(seq, false) AS sequential,
  CASE WHEN u < 0.9 THEN 0 WHEN coalesce(seq, false) AND u > 0.95 THEN 0.9 WHEN greatest > least AND u > 0.95 THEN 0.85 WHEN u > 0.98 THEN 0.7 ELSE 0 END::DOUBLE AS id_confidence,
  CASE WHEN bounded IS NULL OR coalesce(seq, false) OR score < 0.4 THEN 0 ELSE least(score, 0.95) END::DOUBLE AS score_confidence FROM c)"""


def _fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ids = arrays.numeric_profile(e.withColumn("event_id", F.col("event_id").cast("double")), "user_id", "event_id", "event_id")
    return ids.union(arrays.numeric_profile(e, "user_id", "event_id", "value"))


@query(f"WITH {_PROFILES} SELECT * FROM f")
def field_roles(spark, sf_dir):
    """How far each numeric field of an array is an id or a score."""
    return _fields(spark, sf_dir)


@query("""SELECT user_id, max(CASE WHEN k <= 10 THEN 1 ELSE 0 END) = 1 AND avg(iso) FILTER (k <= 10) > 0.5 AS iso_field, min(epoch) BETWEEN 1000000000 AND 2000000000 AS seconds_field
FROM (SELECT user_id, regexp_matches(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}')::INT AS iso, epoch(ts) AS epoch, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) GROUP BY user_id""")
def temporal_fields(spark, sf_dir):
    """Whether the first ten strings of a field are ISO times for the most part, or its least number is a time in seconds."""
    k = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("text"), F.unix_timestamp("ts").alias("seconds"), k.alias("k"))
    iso = F.avg(F.when(F.col("k") <= 10, F.col("text").rlike(arrays.ISO).cast("int"))) > 0.5
    return e.groupBy("user_id").agg(iso.alias("iso_field"), F.min("seconds").between(*arrays.SECONDS).alias("seconds_field"))


_ANALYSIS = f"""WITH {_PROFILES},
i AS (SELECT user_id, max(n) AS n, max(CASE WHEN field = 'event_id' THEN id_confidence END) AS id, max(CASE WHEN field = 'event_id' THEN uniqueness END) AS id_u,
  max(CASE WHEN field = 'value' THEN uniqueness END) AS value_u, max(CASE WHEN field = 'value' THEN score_confidence END) AS score, bool_or(greatest > least) AS varies FROM f GROUP BY user_id),
m AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY user_id),
a AS (SELECT e.user_id, count(*) FILTER (sd > 0 AND abs(value - m) > 2 * sd) AS anomalies, count(*) FILTER (event_type = 'error') AS errors FROM events e JOIN m ON e.user_id = m.user_id GROUP BY e.user_id),
t AS (SELECT user_id, round(count(DISTINCT event_type)::DOUBLE / count(*), 6) AS type_u, (count(DISTINCT event_type) = 1)::INT AS constant FROM events GROUP BY user_id),
d AS (SELECT i.user_id, n, id >= 0.7 AS has_id, greatest(type_u, CASE WHEN id >= 0.7 THEN id_u ELSE 0 END) AS most, greatest(type_u, CASE WHEN id >= 0.7 THEN value_u ELSE (value_u + id_u) / 2 END) AS content,
  score > 0 OR anomalies > 0 OR errors > 0 AS signal, score, varies, constant, anomalies, errors FROM i JOIN a ON i.user_id = a.user_id JOIN t ON i.user_id = t.user_id),
r AS (SELECT *, CASE WHEN content < 0.1 AND has_id THEN 'repetitive_content_with_ids' WHEN most < 0.3 THEN 'low_uniqueness_safe_to_sample' WHEN has_id AND most > 0.8 AND NOT signal THEN 'unique_entities_no_signal'
  WHEN most > 0.8 AND signal THEN 'unique_entities_with_signal' WHEN NOT signal THEN 'medium_uniqueness_no_signal' ELSE 'medium_uniqueness_with_signal' END AS reason,
  CASE WHEN score >= 0.5 THEN 'search_results' ELSE 'generic' END AS kind FROM d),
g AS (SELECT *, CASE WHEN n < 5 THEN 'none' WHEN reason LIKE '%no_signal' THEN 'skip' WHEN kind = 'search_results' THEN 'top_n' ELSE 'smart_sample' END AS strategy FROM r)
SELECT user_id, n, has_id, kind, reason, strategy, anomalies, errors,
  CASE strategy WHEN 'none' THEN 0::DOUBLE WHEN 'skip' THEN 0.3::DOUBLE + 0.2::DOUBLE * (constant / 3.0::DOUBLE) WHEN 'top_n' THEN 0.6::DOUBLE + 0.2::DOUBLE * (constant / 3.0::DOUBLE) ELSE 0.5::DOUBLE + 0.2::DOUBLE * (constant / 3.0::DOUBLE) END AS saves FROM g"""


@query(_ANALYSIS)
def array_analysis(spark, sf_dir):
    """Each user's events as an array of (event_id, event_type, value): its kind, whether and how to cut it, what that saves."""
    one = lambda field, column: F.max(F.when(F.col("field") == field, F.col(column)))
    fields = _fields(spark, sf_dir).groupBy("user_id").agg(
        F.max("n").alias("n"), one("event_id", "id_confidence").alias("id"), one("event_id", "uniqueness").alias("id_u"), one("value", "uniqueness").alias("value_u"),
        one("value", "score_confidence").alias("score"), F.max((F.col("greatest") > F.col("least")).cast("int")).alias("varies"),
    )
    e = table(spark, sf_dir, "events").withColumn("stray", arrays.strays(F.col("value"), "user_id"))
    rest = e.groupBy("user_id").agg(F.count(F.when(F.col("stray"), 1)).alias("anomalies"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
    types = arrays.string_profile(e, "user_id", "event_type").select("user_id", F.col("uniqueness").alias("type_u"), "kinds")
    d = fields.join(rest, "user_id").join(types, "user_id")
    has_id = F.col("id") >= 0.7
    most = F.greatest("type_u", F.when(has_id, F.col("id_u")).otherwise(0.0))
    content = F.greatest("type_u", F.when(has_id, F.col("value_u")).otherwise((F.col("value_u") + F.col("id_u")) / 2))
    signal = (F.col("score") > 0) | (F.col("anomalies") > 0) | (F.col("errors") > 0)
    no = F.lit(False)
    d = d.withColumn("has_id", has_id).withColumn("kind", arrays.pattern(no, F.col("varies") == 1, no, no, F.col("score"))).withColumn("reason", arrays.crushability(content, most, has_id, signal))
    d = d.withColumn("strategy", arrays.strategy(F.col("n"), F.col("reason"), F.col("kind"), no, F.lit(1.0)))
    saves = arrays.reduction(F.col("strategy"), (F.col("kinds") == 1).cast("int") / 3)
    return d.select("user_id", "n", "has_id", "kind", "reason", "strategy", "anomalies", "errors", saves.alias("saves"))


@query("""WITH o AS (SELECT c_custkey, map_keys(m) AS ks, map_values(m) AS vs FROM (SELECT c_custkey, map {'key': c_custkey::VARCHAR, 'name': c_name, 'nation': c_nationkey::VARCHAR, 'segment': c_mktsegment, 'balance': round(c_acctbal)::BIGINT::VARCHAR, 'note': CASE WHEN c_custkey % 7 = 0 THEN 'payment failed' ELSE repeat(c_name, 4) END, 'tier': (c_custkey % 3)::VARCHAR, 'page': repeat('p', 60), 'extra': repeat('e', 70), 'last': 'z'} AS m FROM customer)),
e AS (SELECT c_custkey, unnest(ks) AS name, unnest(vs) AS v, generate_subscripts(ks, 1) - 1 AS p FROM o)
SELECT c_custkey, name, CASE WHEN regexp_matches(lower(v), 'error|fail|exception|traceback|fatal|panic|crash') THEN 'marked' WHEN length(v) <= 10 THEN 'small' WHEN p < 3 OR p >= 9 THEN 'edge' ELSE 'dropped' END AS why FROM e""")
def object_samples(spark, sf_dir):
    """Objects of more than eight keys: values that tell of errors, small ones and those at both ends stay."""
    c = table(spark, sf_dir, "customer")
    note = F.when(F.col("c_custkey") % 7 == 0, "payment failed").otherwise(F.repeat("c_name", F.lit(4)))
    cells = {
        "key": F.col("c_custkey").cast("string"), "name": F.col("c_name"), "nation": F.col("c_nationkey").cast("string"), "segment": F.col("c_mktsegment"), "balance": F.round("c_acctbal").cast("long").cast("string"),
        "note": note, "tier": (F.col("c_custkey") % 3).cast("string"), "page": F.lit("p" * 60), "extra": F.lit("e" * 70), "last": F.lit("z"),
    }
    e = c.select("c_custkey", F.posexplode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("v")) for k, v in cells.items()])).alias("p", "c"))
    v, p = F.col("c.v"), F.col("p")
    why = F.when(F.lower(v).rlike("error|fail|exception|traceback|fatal|panic|crash"), "marked").when(F.length(v) <= 10, "small").when((p < 3) | (p >= len(cells) - 1), "edge").otherwise("dropped")
    return e.select("c_custkey", F.col("c.name").alias("name"), why.alias("why"))


@query("""WITH r AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN to_json(event_type) WHEN 1 THEN value::BIGINT::VARCHAR WHEN 2 THEN props ELSE 'null' END AS item FROM events),
k AS (SELECT *, CASE WHEN item LIKE '{%' THEN 'object' WHEN item LIKE '"%' THEN 'string' WHEN item = 'null' THEN 'null' ELSE 'number' END AS kind FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id, kind) AS n FROM k)
SELECT user_id, event_id, kind, n <= 8 OR k <= 3 OR k > n - 2 AS kept FROM n""")
def mixed_samples(spark, sf_dir):
    """Arrays of several JSON types: each type is cut as an array of its own, items keep their places."""
    e = table(spark, sf_dir, "events")
    case = F.col("event_id") % 4
    item = F.when(case == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).when(case == 1, F.round("value").cast("long").cast("string")).when(case == 2, F.col("props")).otherwise("null")
    name = F.schema_of_variant(F.parse_json(item))
    kind = F.when(name.startswith("OBJECT"), "object").when(name == "STRING", "string").when(name == "VOID", "null").otherwise("number")
    e = e.select("user_id", "event_id", kind.alias("kind"))
    k, n = F.row_number().over(W.partitionBy("user_id", "kind").orderBy("event_id")), F.count(F.lit(1)).over(W.partitionBy("user_id", "kind"))
    return e.select("user_id", "event_id", "kind", ((n <= 8) | (k <= 3) | (k > n - 2)).alias("kept"))


_LINES = "SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents"


@query(f"""WITH l AS ({_LINES}), k AS (SELECT doc_id, ls, CASE WHEN len(ls) <= 6 THEN ls ELSE list_concat(ls[1:4], ls[len(ls) - 1:]) END AS kept FROM l)
SELECT doc_id, len(ls) AS items, len(kept) AS n_kept, CASE WHEN len(ls) > len(kept) THEN '<<ccr:' || substr(sha256(array_to_string(ls, chr(10))), 1, 12) || ' ' || (len(ls) - len(kept)) || '_rows_offloaded>>' END AS marker, sha256(array_to_string(kept, chr(10))) AS restored_sha256 FROM k""")
def dropped_row_markers(spark, sf_dir):
    """Cut arrays with a marker row that names the whole by hash; stripping markers gives the kept rows again."""
    ls = F.split("text", "\n")
    kept = F.when(F.size(ls) <= 6, ls).otherwise(F.concat(F.slice(ls, 1, 4), F.slice(ls, -2, 2)))
    d = table(spark, sf_dir, "documents").select("doc_id", ls.alias("ls"), kept.alias("kept"))
    gone = F.size("ls") - F.size("kept")
    marker = F.when(gone > 0, F.concat(F.lit("<<ccr:"), F.substring(F.sha2(F.array_join("ls", "\n").cast("binary"), 256), 1, 12), F.lit(" "), gone.cast("string"), F.lit("_rows_offloaded>>")))
    d = d.withColumn("marker", marker).withColumn("cut", F.when(gone > 0, F.concat("kept", F.array("marker"))).otherwise(F.col("kept")))
    back = F.filter("cut", lambda x: ~x.rlike("^<<ccr:[0-9a-f]{12} [0-9]+_rows_offloaded>>$"))
    return d.select("doc_id", F.size("ls").alias("items"), F.size("kept").alias("n_kept"), "marker", F.sha2(F.array_join(back, "\n").cast("binary"), 256).alias("restored_sha256"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS word FROM benchmark), c AS (SELECT word, unnest(string_split(word, '')) AS ch FROM w),
p AS (SELECT word, ch, count(*)::DOUBLE / length(word) AS p FROM c GROUP BY word, ch)
SELECT word, CASE WHEN count(*) < 2 THEN 0 ELSE round(abs(sum(p * log2(p))) / log2(count(*)), 6) END::DOUBLE AS by_alphabet, round(abs(sum(p * log2(p))) / log2(length(word)), 6)::DOUBLE AS by_length FROM p GROUP BY word""")
def string_entropies(spark, sf_dir):
    """Shannon entropy of words, over that of their alphabet or of their length."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("word")).distinct()
    n, letters = F.length("word"), F.array_distinct(F.split("word", ""))
    share = lambda c: (n - F.length(F.replace(F.col("word"), c, F.lit("")))) / n
    bits = F.abs(F.aggregate(letters, F.lit(0.0), lambda a, c: a + share(c) * F.log2(share(c))))
    w = w.select("word", bits.alias("h"), F.size(letters).alias("k"), n.alias("n"))
    return w.select("word", F.when(F.col("k") < 2, 0.0).otherwise(F.round(F.col("h") / F.log2("k"), 6)).alias("by_alphabet"), F.round(F.col("h") / F.log2("n"), 6).alias("by_length"))


@query("""WITH s AS (SELECT doc_id, md5(doc_id::VARCHAR) AS h FROM documents), t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) WHEN 1 THEN h ELSE substr(h, 1, 8) || '-' || substr(h, 9, 28) END AS s FROM s)
SELECT doc_id, length(s) = 36 AND s[9] = '-' AND s[14] = '-' AND s[19] = '-' AND s[24] = '-' AND regexp_full_match(replace(s, '-', ''), '[0-9a-fA-F]{32}') AS is_uuid FROM t""")
def uuid_forms(spark, sf_dir):
    """36 characters, hexadecimal in groups of 8, 4, 4, 4 and 12."""
    h = F.md5(F.col("doc_id").cast("string").cast("binary"))
    cut = lambda *at: F.concat_ws("-", *[F.substring(h, a, n) for a, n in at])
    s = F.when(F.col("doc_id") % 3 == 0, cut((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))).when(F.col("doc_id") % 3 == 1, h).otherwise(cut((1, 8), (9, 28)))
    return table(spark, sf_dir, "documents").select("doc_id", s.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").alias("is_uuid"))


@query("""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[' || props || ',' || props || ']' WHEN 1 THEN props WHEN 2 THEN '[1, 2]' ELSE '[' || props || ', 3' END AS t FROM events)
SELECT event_id, coalesce(json_type(try_cast(t AS JSON)) = 'ARRAY' AND len(json_extract(t, '$[*]')) = len(list_filter(json_extract(t, '$[*]'), lambda x: json_type(x) = 'OBJECT')), false) AS dicts FROM p""".replace("json_type(try_cast(t AS JSON)) = 'ARRAY' AND", "json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'ARRAY' AND").replace("json_extract(t, '$[*]')", "json_extract(CASE WHEN json_valid(t) THEN t END, '$[*]')"))  # fmt: skip
def dict_arrays(spark, sf_dir):
    """Whether a text parses to a list of objects."""
    case, props = F.col("event_id") % 4, F.col("props")
    text = F.when(case == 0, F.concat(F.lit("["), props, F.lit(","), props, F.lit("]"))).when(case == 1, props).when(case == 2, "[1, 2]").otherwise(F.concat(F.lit("["), props, F.lit(", 3")))
    kind = F.schema_of_variant(F.try_parse_json(text))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(kind.startswith("ARRAY<OBJECT"), F.lit(False)).alias("dicts"))


@query("""SELECT event_type AS bucket, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, row_number() OVER (ORDER BY event_type) AS place FROM events GROUP BY event_type""")
def discriminator_buckets(spark, sf_dir):
    """Rows by the value that tells their kinds apart, kinds in order."""
    b = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return b.withColumn("place", F.row_number().over(W.orderBy("bucket")))


@query("""WITH h AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS asked FROM events)
SELECT event_id, k IS NOT NULL AND coalesce(contains('looking for ' || k || ' in ' || asked, k), false) AS preserved FROM h""")
def preserved_fields(spark, sf_dir):
    """Whether an item has a field that was learned by the hash of its name, with a value that the query speaks of."""
    e = table(spark, sf_dir, "events")
    learned = F.array(F.substring(F.sha2(F.lit("k").cast("binary"), 256), 1, 8))
    entries = F.map_entries(F.from_json("props", "map<string,string>"))
    asked = F.concat(F.lit("looking for "), F.get_json_object("props", "$.k"), F.lit(" in "), F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id")))
    e = e.withColumn("asked", asked).withColumn("entries", entries)
    hit = F.exists("entries", lambda x: F.array_contains(learned, F.substring(F.sha2(x["key"].cast("binary"), 256), 1, 8)) & F.contains(F.col("asked"), x["value"]))
    return e.select("event_id", F.coalesce(hit, F.lit(False)).alias("preserved"))
