"""Queries that tell kinds of content apart and count what texts hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions import detect
from lodestream.functions import text as T
from lodestream.operators import ranking
from lodestream.plans.registry import query, table
from lodestream.sources import stores


def _share(lines: str, pattern: str) -> str:
    return f"len(list_filter({lines}, lambda l: regexp_matches(l, '{pattern}'))) / len({lines})"


_CASCADE = " ".join(
    f"WHEN {_share('ls', p)} >= {least} THEN '{kind}'" for kind, p, least in ((k, p, at) for k, (p, at) in detect.LINE_KINDS.items())
)


@query(rf"""WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages), l AS (SELECT id, text, string_split(text, chr(10)) AS ls FROM t)
SELECT id, CASE WHEN regexp_matches(text, '^[ \t\n]*[\[{{]') AND json_valid(text) THEN 'json' WHEN regexp_matches(text, '{detect.DIFF}') THEN 'diff' WHEN regexp_matches(lower(text), '{detect.HTML}') THEN 'html' {_CASCADE} ELSE 'plain' END AS kind FROM l""")
def content_cascade(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    both = docs.union(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id")), "html"))
    return both.select("id", detect.content_kind(F.col("text")).alias("kind"))


@query(r"""WITH h AS (SELECT item_id, (['a1b2c3d4-0000-1111-2222-333344445555', '2024-05-06T07:08:09Z', '2024-05-06', '1700000000', '12:34:56', 'v1.2.3', 'sk-abcdefghij0123456789', 'req_abcdefgh12', 'd41d8cd98f00b204e9800998ecf8427e', 'da39a3ee5e6b4b0d3255bfef95601890afd80709', 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855', 'eyJhbGci.eyJzdWIi.sig_1', 'v12 12345678901234 x1:2'])[1 + item_id % 13] AS x FROM benchmark)
SELECT item_id, (x LIKE 'a1b2%')::INT AS n_uuid, (x LIKE '%T07%')::INT AS n_datetime, (x LIKE '2024%')::INT AS n_date, (x = '1700000000' OR x LIKE 'a1b2%' OR x LIKE 'sk-%')::INT AS n_unix_timestamp, (x = '12:34:56' OR x LIKE '%T07%')::INT AS n_time,
 (x = 'v1.2.3')::INT AS n_version, (x LIKE 'sk-%')::INT AS n_api_key, (x LIKE 'req%')::INT AS n_prefixed_id, (x LIKE 'd41d%')::INT AS n_hex_32, (x LIKE 'da39%')::INT AS n_hex_40, (x LIKE 'e3b0%')::INT AS n_hex_64, (x LIKE 'eyJ%')::INT AS n_jwt FROM h""")
def dynamic_kinds(spark, sf_dir):
    """Each kind of changing value at a place of its own, as listed by hand, and values that are none."""
    given = (
        "a1b2c3d4-0000-1111-2222-333344445555", "2024-05-06T07:08:09Z", "2024-05-06", "1700000000", "12:34:56", "v1.2.3", "sk-abcdefghij0123456789", "req_abcdefgh12",
        "d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "eyJhbGci.eyJzdWIi.sig_1", "v12 12345678901234 x1:2",
    )
    x = F.element_at(F.array(*map(F.lit, given)), (F.col("item_id") % len(given) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", *[F.regexp_count(x, F.lit(p)).alias(f"n_{k}") for k, p in detect.VOLATILE.items()])


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')) AS n_uuid, len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 10 AND 13)) AS n_unix_timestamp,
 len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[a-fA-F0-9]{32}'))) AS n_hex_32, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[a-fA-F0-9]{40}'))) AS n_hex_40, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[a-fA-F0-9]{64}'))) AS n_hex_64,
 len(regexp_extract_all(text, 'eyJ[a-zA-Z0-9_-]+[.]eyJ[a-zA-Z0-9_-]+[.][a-zA-Z0-9_-]+')) AS n_jwt FROM documents""")
def dynamic_patterns(spark, sf_dir):
    """How many values of some kinds that change a text holds; the SQL reads whole words and runs instead of boundaries."""
    kinds = ("uuid", "unix_timestamp", "hex_32", "hex_40", "hex_64", "jwt")
    return table(spark, sf_dir, "documents").select("doc_id", *[F.regexp_count("text", F.lit(detect.VOLATILE[k])).alias(f"n_{k}") for k in kinds])


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS n_{k}" for k, p in detect.STRUCTURE.items()) + " FROM documents")
def structure_features(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.regexp_count("text", F.lit(p)).alias(f"n_{k}") for k, p in detect.STRUCTURE.items()])


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
s AS (SELECT doc_id, greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - (regexp_matches(w, '[^aeiouyl]e$'))::INT) AS n FROM w),
c AS (SELECT doc_id, count(*) AS words, sum(n)::BIGINT AS syllables FROM s GROUP BY doc_id),
e AS (SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS sentences FROM documents)
SELECT doc_id, words, syllables, sentences, 206.835::DOUBLE - 1.015::DOUBLE * (words::DOUBLE / sentences) - 84.6::DOUBLE * (syllables::DOUBLE / words) AS ease FROM c JOIN e USING (doc_id)""")
def readability(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"[.!?]+"))).alias("sentences"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("ws"))
    words = docs.select("doc_id", "sentences", F.explode("ws").alias("w"))
    n = F.greatest(F.lit(1), F.regexp_count("w", F.lit("[aeiouy]+")) - F.col("w").rlike("[^aeiouyl]e$").cast("int"))
    c = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.sum(n).alias("syllables"), F.first("sentences").alias("sentences"))
    ease = 206.835 - 1.015 * (F.col("words") / F.col("sentences")) - 84.6 * (F.col("syllables") / F.col("words"))
    return c.select("doc_id", "words", "syllables", "sentences", ease.alias("ease"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{k}'" for k, p in detect.PATH_KINDS.items()) + " ELSE 'other' END AS kind FROM pages) GROUP BY kind")
def path_classes(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(detect.first_match(F.lower("url"), detect.PATH_KINDS, "other").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') AS is_integer, json_type(props) AS kind FROM events""")
def json_types(spark, sf_dir):
    kind = F.when(F.ltrim("props").startswith("{"), "OBJECT").when(F.ltrim("props").startswith("["), "ARRAY").otherwise("OTHER")
    whole = F.expr("schema_of_variant(variant_get(parse_json(props), '$.k')) = 'BIGINT'")
    return table(spark, sf_dir, "events").select("event_id", whole.alias("is_integer"), kind.alias("kind"))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT user_id, event_type, min(pos) AS begins, max(pos) + 1 AS ends FROM e GROUP BY user_id, event_type, island""")
def mask_spans(spark, sf_dir):
    """Runs of equal marks as spans."""
    order = ["ts", "event_id"]
    pos = F.row_number().over(W.partitionBy("user_id").orderBy(*order)) - 1
    e = table(spark, sf_dir, "events").withColumn("pos", pos).withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("user_id", "event_type").orderBy(*order)))
    return e.groupBy("user_id", "event_type", "island").agg(F.min("pos").alias("begins"), (F.max("pos") + 1).alias("ends")).drop("island")


@query("""WITH p AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])
  / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS similarity
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM p WHERE similarity >= 0.3) WHERE rank = 1""")
def semantic_cache(spark, sf_dir):
    """The cached entry that answers a query, if any is similar enough."""
    v = table(spark, sf_dir, "embeddings")
    return ranking.nearest(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 1, 0.3).drop("rank")


@query("""WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant')
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.k, a.k) AS k, u.turn AS asked, a.turn AS answered FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.k = a.k""")
def exchange_pairs(spark, sf_dir):
    """Two sides of a conversation paired by their order."""
    c = table(spark, sf_dir, "conversations")
    k = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    side = lambda role, name: c.where(F.col("role") == role).select("conv_id", k.alias("k"), F.col("turn").alias(name))
    return side("user", "asked").join(side("assistant", "answered"), ["conv_id", "k"], "full")


@query("""WITH w AS (SELECT sum(coalesce(list_sum(list_transform(regexp_extract_all(html, '<[A-Za-z/][^<>]*>'), lambda x: length(x))), 0))::BIGINT AS tags,
  sum(coalesce(list_sum(list_transform(regexp_extract_all(html, '<!--[^>]*-->'), lambda x: length(x))), 0))::BIGINT AS comments FROM pages),
l AS (UNPIVOT w ON tags, comments INTO NAME kind VALUE total)
SELECT kind, total, round(100.0 * total / max(total) OVER (), 2)::DOUBLE AS percent_of_most FROM l""")
def waste_histogram(spark, sf_dir):
    w = T.waste(F.col("html"))
    sums = table(spark, sf_dir, "pages").agg(F.sum(w["tags"]).alias("tags"), F.sum(w["comments"]).alias("comments")).unpivot([], ["tags", "comments"], "kind", "total")
    return sums.withColumn("percent_of_most", F.round(100 * F.col("total") / F.max("total").over(W.partitionBy()), 2))


def _facts(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]{2,}"), F.lit(0)))


@query("""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
f AS (SELECT conv_id, turn, text, list_distinct(regexp_extract_all(before, '[0-9]{2,}')) AS facts FROM c WHERE before IS NOT NULL)
SELECT conv_id, turn, len(facts) AS facts, CASE WHEN len(facts) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(facts, lambda x: contains(text, x)))::DOUBLE / len(facts), 4) END AS recall FROM f""")
def information_recall(spark, sf_dir):
    """The share of one text's numbers that the next one still holds."""
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    c = c.withColumn("facts", _facts(F.col("before")))
    kept = F.size(F.filter("facts", lambda x: F.contains(F.col("text"), x)))
    return c.select("conv_id", "turn", F.size("facts").alias("facts"), F.when(F.size("facts") == 0, 1.0).otherwise(F.round(kept / F.size("facts"), 4)).alias("recall"))


@query("""WITH k AS (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events), v AS (SELECT event_type, key, json_extract_string(props, '$.' || key) AS value FROM k)
SELECT event_type, key, count(*) AS n, CASE WHEN bool_and(regexp_matches(value, '^-?[0-9]+$')) THEN 'int' WHEN bool_and(regexp_matches(value, '^-?[0-9]+([.][0-9]+)?$')) THEN 'float' ELSE 'string' END AS tag FROM v GROUP BY event_type, key""")
def schema_inference(spark, sf_dir):
    """Keys of JSON objects with how many rows have them and one type for all their values."""
    v = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    all_match = lambda p: F.bool_and(F.col("value").rlike(p))
    tag = F.when(all_match("^-?[0-9]+$"), "int").when(all_match("^-?[0-9]+([.][0-9]+)?$"), "float").otherwise("string")
    return v.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), tag.alias("tag"))


@query("""WITH k AS (SELECT DISTINCT event_type, unnest(json_keys(props)) AS key FROM events)
SELECT event_type, substr(sha256(string_agg(key, ',' ORDER BY key)), 1, 16) AS signature FROM k GROUP BY event_type""")
def tool_signature(spark, sf_dir):
    """A structural hash of the objects of each kind."""
    k = table(spark, sf_dir, "events").select("event_type", F.explode(F.expr("json_object_keys(props)")).alias("key"))
    keys = F.array_join(F.array_sort(F.collect_set("key")), ",")
    return k.groupBy("event_type").agg(F.substring(F.sha2(keys.cast("binary"), 256), 1, 16).alias("signature"))


@query("""WITH l AS (UNPIVOT (SELECT o_orderstatus, o_orderpriority FROM orders) ON o_orderstatus, o_orderpriority INTO NAME field VALUE value),
s AS (SELECT field, count(DISTINCT value) AS kinds, count(*) AS n FROM l GROUP BY field)
SELECT field, kinds FROM s WHERE kinds BETWEEN 2 AND 8 AND kinds <= 0.7 * n AND n = (SELECT count(*) FROM orders) ORDER BY kinds DESC, field LIMIT 1""")
def discriminator(spark, sf_dir):
    """The text column that best parts records into a few kinds: present in all rows, 2 to 8 values, the most of them."""
    orders = table(spark, sf_dir, "orders")
    total = orders.agg(F.count(F.lit(1)).alias("total"))
    s = orders.unpivot([], ["o_orderstatus", "o_orderpriority"], "field", "value").groupBy("field").agg(F.countDistinct("value").alias("kinds"), F.count("value").alias("n"))
    fit = s.join(F.broadcast(total)).where(F.col("kinds").between(2, 8) & (F.col("kinds") <= 0.7 * F.col("n")) & (F.col("n") == F.col("total")))
    return fit.orderBy(F.desc("kinds"), "field").limit(1).select("field", "kinds")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events),
c AS (SELECT user_id, event_type, count(*) AS n FROM r WHERE r > 5 GROUP BY ALL)
SELECT user_id, string_agg(n || ' ' || event_type, ', ' ORDER BY n DESC, event_type) AS summary FROM c GROUP BY user_id""")
def dropped_summary(spark, sf_dir):
    """What a selection left out, by kind, as a sentence for each group."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    c = table(spark, sf_dir, "events").withColumn("r", rank).where("r > 5").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "event_type", F.concat_ws(" ", "n", "event_type").alias("text"))))
    return c.groupBy("user_id").agg(F.array_join(F.transform(kinds, lambda x: x["text"]), ", ").alias("summary"))


@query("""WITH a AS (SELECT event_type, count(*) AS samples, sum(value::DECIMAL(28, 2))::DOUBLE / count(*) AS mean FROM events WHERE user_id % 2 = 0 GROUP BY event_type),
b AS (SELECT event_type, count(*) AS samples, sum(value::DECIMAL(28, 2))::DOUBLE / count(*) AS mean FROM events WHERE user_id % 2 = 1 GROUP BY event_type)
SELECT event_type, sum(samples)::BIGINT AS samples, round(sum(mean * samples) / sum(samples), 6) AS mean FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY event_type""")
def pattern_merge(spark, sf_dir):
    """Two instances' learned means as one, weighted by samples."""
    mean = F.sum(F.col("value").cast("decimal(28,2)")).cast("double") / F.count(F.lit(1))
    learned = lambda rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("samples"), mean.alias("mean"))
    events = table(spark, sf_dir, "events")
    both = stores.merged_patterns(learned(events.where("user_id % 2 = 0")), learned(events.where("user_id % 2 = 1")), "event_type", "samples", ["mean"])
    return both.withColumn("mean", F.round("mean", 6))


@query("""WITH d AS (SELECT doc_id, source, md5(text) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS k FROM d)
SELECT source, count(*) AS reads, count(*) FILTER (k > 1) AS rereads FROM r GROUP BY source""")
def read_redundancy(spark, sf_dir):
    """How often each source gave what had been read before."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first")).select(F.upper("h").alias("key"), "first")
    r = d.withColumn("key", F.upper("h")).join(first, "key")
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("reads"), F.count(F.when(F.col("doc_id") != F.col("first"), 1)).alias("rereads"))


@query("""WITH t AS (SELECT conv_id, turn, role, len(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS words FROM conversations),
s AS (SELECT conv_id, count(*) FILTER (role = 'user') AS turns, count(*) FILTER (role = 'assistant' AND words >= 150) AS long_answers, count(*) FILTER (role = 'assistant') AS answers FROM t GROUP BY conv_id)
SELECT conv_id, turns, CASE WHEN turns < 10 THEN 2 WHEN long_answers / greatest(1, answers) >= 0.3 THEN 3 WHEN long_answers / greatest(1, answers) >= 0.1 THEN 2 ELSE 1 END AS level FROM s""")
def verbosity_levels(spark, sf_dir):
    """The level of brevity that a conversation's long answers speak for."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "role", F.size(T.words(F.col("text"))).alias("words"))
    answer = F.col("role") == "assistant"
    s = t.groupBy("conv_id").agg(F.count(F.when(F.col("role") == "user", 1)).alias("turns"), F.count(F.when(answer & (F.col("words") >= 150), 1)).alias("long"), F.count(F.when(answer, 1)).alias("answers"))
    return s.select("conv_id", "turns", T.verbosity_level(F.col("long") / F.greatest(F.lit(1), F.col("answers")), F.col("turns")).alias("level"))
