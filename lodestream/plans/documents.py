"""Queries over documents, pages, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.operators import compressors, graphs, profile, ranking, similarity
from lodestream.plans.registry import query, table

_SPACE = r"[ \t\n\x0B\f\r]+"
_TERM = T.TERM


@query("""SELECT doc_id, floor(length(text) / 4.0::DOUBLE + 0.5)::BIGINT AS tokens, CASE WHEN length(text) / 4.0 + 0.5 < 2000 THEN 'xs' WHEN floor(length(text) / 4.0::DOUBLE + 0.5) < 8000 THEN 's'
  WHEN floor(length(text) / 4.0::DOUBLE + 0.5) < 32000 THEN 'm' WHEN floor(length(text) / 4.0::DOUBLE + 0.5) < 128000 THEN 'l' ELSE 'xl' END AS bucket FROM documents""")
def token_estimate(spark, sf_dir):
    tokens = T.size_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), T.input_bucket(tokens).alias("bucket"))


@query("""SELECT conv_id, count(*) AS messages, sum(4 + floor(length(text) / 4.0::DOUBLE + 0.5))::BIGINT + 3 AS tokens FROM conversations GROUP BY conv_id""")
def message_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), (F.sum(4 + T.size_tokens(F.col("text"))) + 3).alias("tokens"))


@query("""WITH d AS (SELECT doc_id, lang || '|' || CASE WHEN n_chars < 2000 THEN 'xs' WHEN n_chars < 8000 THEN 's' WHEN n_chars < 32000 THEN 'm' WHEN n_chars < 128000 THEN 'l' ELSE 'xl' END AS stratum,
  CASE WHEN ('0x' || substr(sha256('arm:' || doc_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.1 THEN 'control' ELSE 'treatment' END AS arm FROM documents)
SELECT stratum, arm, count(*) AS n FROM d GROUP BY ALL""")
def strata_and_arms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stratum = F.concat_ws("|", "lang", T.input_bucket(F.col("n_chars")))
    return d.groupBy(stratum.alias("stratum"), T.arm(F.col("doc_id").cast("string"), 0.1).alias("arm")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, substr(sha256(text), 1, 24) AS content_key, substr(md5(text), 1, 16) AS block_hash FROM documents""")
def content_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_key(F.col("text")).alias("content_key"), T.block_hash(F.col("text")).alias("block_hash"))


@query("""SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)""")
def exact_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    return similarity.first_of_equal(rows, F.col("hash"), ["doc_id"]).select("doc_id", "copies")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT regexp_replace(regexp_replace(regexp_replace(line, '0x[0-9a-fA-F]+', '<hex>', 'g'), '(/[A-Za-z0-9_.-]+)+', '<path>', 'g'), '[0-9]+', '<n>', 'g') AS key FROM l)
SELECT substr(md5(key), 1, 16) AS line_hash, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1""")
def repeated_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    counted = lines.groupBy(similarity.line_key(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.select(T.block_hash(F.col("key")).alias("line_hash"), "n")


_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


@query(f"""WITH s AS (SELECT item_id, list_distinct({_WORDS.format("text")}) AS w FROM benchmark)
SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))), 6) AS jaccard
FROM s x JOIN s y ON x.item_id < y.item_id WHERE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) >= 0.3""")
def word_jaccard(spark, sf_dir):
    return similarity.word_jaccard_pairs(table(spark, sf_dir, "benchmark"), "item_id", "text", 0.3)


_TURNS = """WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), p AS (SELECT * FROM c WHERE before IS NOT NULL)"""


def _turn_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.where(F.col("before").isNotNull()).select("conv_id", "turn", "text", "before")


@query(f"""{_TURNS}, a AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({_WORDS.format("text")}) AS w FROM p) GROUP BY ALL),
b AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({_WORDS.format("before")}) AS w FROM p) GROUP BY ALL),
m AS (SELECT a.conv_id, a.turn, sum(least(a.n, b.n))::BIGINT AS common FROM a JOIN b USING (conv_id, turn, w) GROUP BY ALL)
SELECT p.conv_id, p.turn, len({_WORDS.format("text")}) AS n_left, len({_WORDS.format("before")}) AS n_right, coalesce(common, 0) AS common,
  round(CASE WHEN len({_WORDS.format("text")}) + len({_WORDS.format("before")}) = 0 THEN 1 ELSE 2 * coalesce(common, 0) / (len({_WORDS.format("text")}) + len({_WORDS.format("before")})) END, 6) AS f1
FROM p LEFT JOIN m ON p.conv_id = m.conv_id AND p.turn = m.turn""")
def token_f1(spark, sf_dir):
    return similarity.bag_overlap(_turn_pairs(spark, sf_dir), ["conv_id", "turn"], "text", "before")


@query(f"""{_TURNS}, w AS (SELECT conv_id, turn, {_WORDS.format("text")} AS o, {_WORDS.format("before")} AS c FROM p),
g AS (SELECT conv_id, turn, CASE WHEN len(o) < 8 THEN [] ELSE list_transform(range(1, len(o) - 6), lambda i: array_to_string(o[i:i + 7], ' ')) END AS og,
  CASE WHEN len(c) < 8 THEN [] ELSE list_transform(range(1, len(c) - 6), lambda i: array_to_string(c[i:i + 7], ' ')) END AS cg FROM w)
SELECT conv_id, turn, round(CASE WHEN len(og) = 0 THEN 0 ELSE len(list_filter(og, lambda x: list_contains(cg, x))) / len(og) END, 6)::DOUBLE AS echo FROM g""")
def echo_ratio(spark, sf_dir):
    return similarity.contained_share(_turn_pairs(spark, sf_dir), ["conv_id", "turn"], "text", "before", 8)


_BM25 = f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{_TERM}') AS ts FROM documents), q AS (SELECT item_id AS query, regexp_extract_all(lower(text), '{_TERM}') AS ts FROM benchmark WHERE item_id % 50 = 0),
t AS (SELECT id, len(ts) AS length, term, count(*) AS tf FROM (SELECT id, ts, unnest(ts) AS term FROM d) GROUP BY ALL),
a AS (SELECT query, term, count(*) AS qf FROM (SELECT query, unnest(ts) AS term FROM q) GROUP BY ALL), s AS (SELECT avg(len(ts)) AS mean, count(*) AS docs FROM d),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
m AS (SELECT query, id, sum(IDF * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)) * qf) AS raw, count(*) AS matched, max(strlen(t.term)) AS longest
  FROM t JOIN a ON t.term = a.term JOIN df ON df.term = t.term, s GROUP BY ALL)
SELECT query, id, round(raw, 4) AS raw, matched, round(least(least(raw / 10, 1) + CASE WHEN longest >= 8 THEN 0.3::DOUBLE ELSE 0 END, 1), 4) AS score FROM m"""


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where("item_id % 50 = 0")


@query(_BM25.replace("IDF", "0.6931471805599453::DOUBLE"))
def bm25(spark, sf_dir):
    return ranking.keyword_scores(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), "doc_id", "text", "item_id", "text")


@query(_BM25.replace("IDF", "ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"))
def full_text_search(spark, sf_dir):
    return ranking.keyword_scores(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), "doc_id", "text", "item_id", "text", corpus_idf=True)


@query("""WITH p AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])
  / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS similarity
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM p) WHERE rank <= 10""")
def vector_top_k(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return ranking.nearest(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(list_avg(embedding::DOUBLE[]), 5) AS mean, list_min(embedding)::DOUBLE AS least, list_max(embedding)::DOUBLE AS greatest FROM embeddings""")
def embedding_features(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda f: F.aggregate(e, F.lit(0.0), lambda a, x: a + f(x))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(total(lambda x: x * x)), 5).alias("norm"), F.round(total(lambda x: x) / F.size(e), 5).alias("mean"), F.array_min(e).alias("least"), F.array_max(e).alias("greatest"))


@query("""WITH a AS (SELECT user_id, max(ts) AS last_ts, count(*) AS uses, max(value) AS importance FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, round(exp(-age / 30.0::DOUBLE), 6) AS recency, round(least(1, importance / 1000 * exp(-0.05::DOUBLE * age) + least(0.3::DOUBLE, 0.05::DOUBLE * uses)), 6) AS weight
FROM (SELECT *, (epoch_us(now) - epoch_us(last_ts)) / 86400000000.0::DOUBLE AS age FROM a, n)""")
def recency_rank(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    a = events.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("uses"), F.max("value").alias("importance")).join(F.broadcast(now))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    age = (micros("now") - micros("last_ts")) / 86400000000.0
    return a.select("user_id", F.round(ranking.recency(age), 6).alias("recency"), F.round(ranking.decayed_importance(F.col("importance") / 1000, age, F.col("uses")), 6).alias("weight"))


@query(rf"""SELECT item_id, CASE WHEN regexp_matches(lower(text), '{T.UUID}') THEN 0.85::DOUBLE WHEN len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])[0-9]{{4,}}(?:[^A-Za-z0-9_]|$)')) >= 2 THEN 0.75
  WHEN len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])[0-9]{{4,}}(?:[^A-Za-z0-9_]|$)')) = 1 THEN 0.65 WHEN regexp_matches(text, '{T.EMAIL}') THEN 0.6 ELSE 0.5 END AS alpha FROM benchmark""")
def hybrid_alpha(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.hybrid_alpha(F.col("text")).alias("alpha"))


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{T.UUID}') || regexp_extract_all(lower(text), '[0-9]{{4,}}') || regexp_extract_all(lower(text), '"([^"]{{1,50}})"', 1)
  || regexp_extract_all(lower(text), '{T.EMAIL.replace("A-Za-z", "a-z")}'))), '|') AS anchors FROM documents""")
def query_anchors(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.anchors(F.col("text")), "|").alias("anchors"))


@query("SELECT doc_id, regexp_matches(lower(text), '" + "|".join(T.ERROR_WORDS) + "') AS weak, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in T.ERROR_WORDS) + " >= 2 AS strong FROM documents")
def error_indicators(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_error_words(F.col("text")).alias("weak"), T.has_strong_error(F.col("text")).alias("strong"))


@query("WITH l AS (SELECT unnest(string_split(lower(text), chr(10))) AS line FROM documents), k AS (SELECT CASE " + " ".join(f"WHEN regexp_matches(line, '(^|[^a-z0-9_])({'|'.join(ws)})([^a-z0-9_]|$)') THEN '{k}'" for k, ws in T.IMPORTANCE.items()) + " ELSE 'none' END AS kind FROM l) SELECT kind, count(*) AS n FROM k GROUP BY kind")
def line_importance(spark, sf_dir):
    return profile.importance_counts(table(spark, sf_dir, "documents"), "text")


_TOTAL = "coalesce(list_sum(list_transform(regexp_extract_all(html, '{0}'), lambda x: length(x))), 0)::BIGINT"


@query("SELECT page_id, " + ", ".join(f"{_TOTAL.format(p)} AS {k}" for k, p in (("tags", "<[A-Za-z/][^<>]*>"), ("comments", "<!--[^>]*-->"), ("base64", "[A-Za-z0-9+/]{64,}=*"), ("spaces", r"[ \t\n]{4,}"))) + " FROM pages")
def waste_signals(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(k) for k, c in T.waste(F.col("html")).items()])


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0), n AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY ALL)
SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy FROM n GROUP BY doc_id""")
def char_entropy(spark, sf_dir):
    return similarity.char_entropy(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query("""WITH g AS (SELECT doc_id, list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)) AS g FROM documents WHERE length(text) >= 3)
SELECT doc_id, round(1 - len(list_distinct(g)) / len(g), 6) AS repetition FROM g""")
def trigram_repetition(spark, sf_dir):
    return similarity.gram_repetition(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS w FROM documents), n AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS words, count(*) AS kinds, round(10000 * (sum(n * n) - sum(n)) / (sum(n) * sum(n)), 4)::DOUBLE AS yule_k FROM n GROUP BY doc_id""")
def vocabulary(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return n.groupBy("doc_id").agg(total.alias("words"), F.count(F.lit(1)).alias("kinds"), F.round(10000 * (F.sum(F.col("n") * F.col("n")) - total) / (total * total), 4).alias("yule_k"))


@query("""WITH m AS (SELECT *, md5(text) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY conv_id, h ORDER BY pos) AS gap FROM m)
SELECT conv_id, count(*) FILTER (gap > 3) AS reserved, count(*) FILTER (gap <= 3) AS polls FROM g GROUP BY conv_id""")
def reserve_gaps(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").withColumn("h", F.md5(F.col("text").cast("binary"))).withColumn("pos", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)
    g = m.withColumn("gap", F.col("pos") - F.lag("pos").over(W.partitionBy("conv_id", "h").orderBy("pos")))
    return g.groupBy("conv_id").agg(F.count(F.when(F.col("gap") > 3, 1)).alias("reserved"), F.count(F.when(F.col("gap") <= 3, 1)).alias("polls"))


@query("""WITH r AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) - turn AS left_turns FROM conversations),
s AS (SELECT list_sort(list(left_turns)) AS l FROM r) SELECT l[len(l) // 2 + 1] AS p50, l[floor(0.9 * len(l))::INT + 1] AS p90 FROM s""")
def residency(spark, sf_dir):
    last = F.max("turn").over(W.partitionBy("conv_id"))
    r = table(spark, sf_dir, "conversations").select((last - F.col("turn")).alias("left_turns"))
    # nearest rank from counts by value, so that no list of all rows is made
    c = r.groupBy("left_turns").agg(F.count(F.lit(1)).alias("n"))
    up = W.orderBy("left_turns")
    c = c.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(W.partitionBy()))
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col("left_turns")))
    return c.agg(at(F.expr("total div 2")).alias("p50"), at(F.floor(F.lit(0.9) * F.col("total"))).alias("p90"))


@query("""SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) - turn AS next_touch FROM conversations""")
def next_touch(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.lead("turn").over(W.partitionBy("conv_id", "role").orderBy("turn")) - F.col("turn")).alias("next_touch"))


@query("""SELECT conv_id, turn FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS live FROM conversations) WHERE turn >= 2 AND turn >= live""")
def live_zone(spark, sf_dir):
    live = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("conv_id"))
    return table(spark, sf_dir, "conversations").withColumn("live", live).where((F.col("turn") >= 2) & (F.col("turn") >= F.col("live"))).select("conv_id", "turn")


@query("""SELECT conv_id, CASE WHEN role <> 'user' THEN 'unknown' WHEN length(text) = 0 THEN 'mechanical' ELSE 'new_ask' END AS kind
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1""")
def turn_kind(spark, sf_dir):
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("m"))
    return last.select("conv_id", F.when(F.col("m.role") != "user", "unknown").when(F.length("m.text") == 0, "mechanical").otherwise("new_ask").alias("kind"))


@query("""WITH c AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, len(ls) AS n, len(list_filter(ls, lambda l: regexp_matches(l, '^[^ \\t\\n:]+:[0-9]+:'))) AS hits, len(list_filter(ls, lambda l: contains(l, ' | '))) AS pipes FROM c)
SELECT doc_id, CASE WHEN hits / n >= 0.3 THEN 'search' WHEN pipes / n >= 0.5 THEN 'tabular' ELSE 'plain' END AS kind FROM r""".replace("\\\\", "\\"))
def content_kind(spark, sf_dir):
    lines = F.split("text", "\n")
    share = lambda f: F.size(F.filter(lines, f)) / F.size(lines)
    kind = F.when(share(lambda x: x.rlike(r"^[^ \t\n:]+:[0-9]+:")) >= 0.3, "search").when(share(lambda x: F.contains(x, F.lit(" | "))) >= 0.5, "tabular").otherwise("plain")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))


@query("""SELECT conv_id, turn, 2000.0::DOUBLE * (1.25::DOUBLE + 0.1::DOUBLE * (turn - 1.0::DOUBLE)) - 1.0::DOUBLE * (1.25::DOUBLE - 0.1::DOUBLE) * (length(text) + 2000) AS gain,
  (1.25::DOUBLE - 0.1::DOUBLE) / 0.1::DOUBLE * length(text) / 2000 AS break_even FROM conversations""")
def mutation_gain(spark, sf_dir):
    suffix = F.length("text")
    gain = T.net_gain(F.lit(2000), suffix, F.col("turn").cast("double"), F.lit(1.0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gain.alias("gain"), T.break_even_reads(F.lit(2000), suffix).alias("break_even"))


_EDGES = """e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation)"""


def _edges(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders = table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
    customers = table(spark, sf_dir, "customer").select(name("n", "c_nationkey"), name("c", "c_custkey"))
    nations = table(spark, sf_dir, "nation").select(name("r", "n_regionkey"), name("n", "n_nationkey"))
    return orders.union(customers).union(nations).distinct()


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e),
w AS (SELECT 'c' || c_custkey AS node, 0 AS depth FROM customer WHERE c_custkey % 50 = 0 UNION SELECT v, depth + 1 FROM w JOIN b ON node = u WHERE depth < 3) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def k_hop(spark, sf_dir):
    """What lies within three edges of the customers whose key is divisible by 50, at the distance of the nearest."""
    seeds = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graphs.neighbourhood(_edges(spark, sf_dir), seeds, 3)


@query(f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'r1' AS node, 0 AS depth, 'r1' AS path UNION ALL SELECT dst, depth + 1, path || '>' || dst FROM w JOIN e ON node = src WHERE depth < 3)
SELECT node, depth, path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, path) AS k FROM w) WHERE k = 1""")
def shortest_path(spark, sf_dir):
    return graphs.shortest_paths(_edges(spark, sf_dir), "r1", 3)


@query("""WITH RECURSIVE l AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT event_id AS root, event_id AS id, 0 AS age FROM l UNION ALL SELECT root, before, age + 1 FROM s JOIN l ON id = event_id WHERE before IS NOT NULL AND age < 4) SELECT root, id, age FROM s""")
def history_chain(spark, sf_dir):
    before = F.lag("event_id").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    links = table(spark, sf_dir, "events").select("event_id", before.alias("before"))
    return graphs.history(links, links, 4, "event_id", "before")


_SIMHASH = """WITH g AS (SELECT item_id AS id, unnest(list_transform(range(1, greatest(1, length(text) - 3) + 1), lambda i: substr(lower(text), i, 4))) AS g FROM benchmark),
h AS (SELECT id, [('0x' || substr(md5(g), 1, 8))::BIGINT, ('0x' || substr(md5(g), 9, 8))::BIGINT] AS x FROM g),
v AS (SELECT id, w, k, sum(CASE WHEN (x[w] >> k) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM h, (SELECT unnest([1, 2]) AS w), (SELECT unnest(range(32)) AS k) GROUP BY ALL),
b AS (SELECT id, sum(CASE WHEN w = 1 AND s > 0 THEN 1::BIGINT << k ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN w = 2 AND s > 0 THEN 1::BIGINT << k ELSE 0 END)::BIGINT AS lo FROM v GROUP BY id)"""


@query(_SIMHASH + " SELECT id, hi, lo FROM b")
def simhash(spark, sf_dir):
    return similarity.simhash(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(_SIMHASH + """, o AS (SELECT hi, lo, min(id) AS id FROM b GROUP BY ALL)
SELECT x.id AS a, y.id AS b, bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS distance FROM o x JOIN o y ON x.id < y.id WHERE distance <= 3""")
def near_duplicate_pairs(spark, sf_dir):
    return similarity.simhash_pairs(simhash(spark, sf_dir))


@query()
def near_duplicate_documents(spark, sf_dir):
    """Over all documents, with the members of each hash."""
    return similarity.simhash_links(similarity.simhash(table(spark, sf_dir, "documents"), "doc_id", "text"))


_STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style|nav|header|footer|aside)[^>]*>.*?</(script|style|nav|header|footer|aside)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'), ' ')"""


@query(f"SELECT page_id, md5({_STRIP}) AS text_md5, length({_STRIP}) AS chars FROM pages")
def page_text(spark, sf_dir):
    text = compressors.page_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.cast("binary")).alias("text_md5"), F.length(text).alias("chars"))


@query()
def crushed_text(spark, sf_dir):
    return compressors.crushed_text(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def crushed_arrays(spark, sf_dir):
    """One array for each user, of that user's events, as rows of items."""
    record = F.struct("event_id", "event_type", "value")
    at = F.row_number().over(W.partitionBy("user_id").orderBy(record)) - 1
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), at.alias("at"), F.to_json(record).alias("item"))
    return compressors.crushed_items(items).withColumnRenamed("id", "user_id")
