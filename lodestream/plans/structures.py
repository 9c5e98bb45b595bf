"""Queries that render records, judge their fields, split mixed texts and score answers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions import detect
from lodestream.functions import fields as X
from lodestream.functions import text as T
from lodestream.operators import nested
from lodestream.plans.registry import query, table

_CASES = " ".join(f"WHEN regexp_matches(l, '{p}') THEN '{k}'" for k, (p, _) in detect.LINE_KINDS.items())
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


@query(rf"""WITH c AS (SELECT 'd' || doc_id AS id, text AS v FROM documents UNION ALL SELECT 'e' || event_id, props FROM events UNION ALL SELECT 'p' || page_id, html FROM pages)
SELECT id, CASE WHEN v IS NULL THEN 'null' WHEN regexp_matches(v, '^[ \t\n]*[\[{{]') AND json_valid(v) THEN 'json' WHEN length(v) >= 64 AND regexp_matches(v, '^[A-Za-z0-9+/]+=*$') THEN 'base64'
  WHEN regexp_matches(lower(v), '{detect.HTML}') THEN 'html' WHEN strlen(v) > 256 THEN 'long' ELSE 'scalar' END AS class FROM c""")
def cell_classes(spark, sf_dir):
    cells = [("documents", "d", "doc_id", "text"), ("events", "e", "event_id", "props"), ("pages", "p", "page_id", "html")]
    parts = [table(spark, sf_dir, t).select(F.concat(F.lit(c), F.col(k)).alias("id"), X.cell_class(F.col(v)).alias("class")) for t, c, k, v in cells]
    return parts[0].union(parts[1]).union(parts[2])


@query("""SELECT event_id, concat_ws(chr(10), 'event_id: ' || event_id, 'event_type: ' || event_type, 'user_id: ' || user_id, 'props.k: ' || json_extract_string(props, '$.k')) AS text FROM events""")
def record_lines(spark, sf_dir):
    """Records as lines of key and value, an object's keys flattened one level."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "map<string,string>"))
    cells = {"event_id": F.col("event_id"), "event_type": F.col("event_type"), "user_id": F.col("user_id"), "props.k": F.col("p")["k"]}
    return e.select("event_id", X.key_value_lines(cells).alias("text"))


_QUOTED = "CASE WHEN {0} IS NULL THEN '' WHEN regexp_matches({0}, '[,\"\\n\\r]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query("SELECT doc_id, md5(concat_ws(',', " + ", ".join(_QUOTED.format(c) for c in ("lang", "source", "text")) + ")) AS line_md5 FROM documents")
def csv_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.csv_line(F.col("lang"), F.col("source"), F.col("text")).cast("binary")).alias("line_md5"))


@query("""SELECT event_id, CAST(json_object('event_id', event_id, 'event_type', event_type, 'props', json(props), 'user_id', user_id) AS VARCHAR) AS text FROM events""")
def canonical_json(spark, sf_dir):
    """Records as JSON with sorted keys and no spaces."""
    fields = F.struct("event_id", "event_type", F.parse_json("props").alias("props"), "user_id")
    return table(spark, sf_dir, "events").select("event_id", F.to_json(fields).alias("text"))


@query("""WITH c AS (SELECT event_type, key, list_contains(json_keys(props), key) AS there, json_extract_string(props, '$.' || key) AS v FROM events, (VALUES ('k'), ('label')) AS w(key))
SELECT event_type, key, count(*) FILTER (NOT there) AS missing, count(*) FILTER (there AND v IS NULL) AS nulls, count(v) AS filled FROM c GROUP BY event_type, key""")
def cell_states(spark, sf_dir):
    """How often a key is missing, null and filled: three different states."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "map<string,string>"))
    e = e.select("event_type", F.explode(F.array(F.lit("k"), F.lit("label"))).alias("key"), "p")
    there, value = F.map_contains_key("p", F.col("key")), F.try_element_at("p", F.col("key"))
    count = lambda c: F.count(F.when(c, 1))
    return e.groupBy("event_type", "key").agg(count(~there).alias("missing"), count(there & value.isNull()).alias("nulls"), F.count(value).alias("filled"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, count(DISTINCT value) / count(*) AS unique_ratio, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY user_id),
o AS (SELECT e.user_id, count(*) FILTER (abs(value - m) > 2 * sd) AS outliers FROM events e JOIN s ON e.user_id = s.user_id GROUP BY e.user_id)
SELECT s.user_id, n, round(unique_ratio, 6) AS unique_ratio, CASE WHEN sd = 0 THEN 'zero' WHEN sd * sd < 10 THEN 'low' WHEN sd * sd < 1000 THEN 'medium' ELSE 'high' END AS spread, outliers FROM s JOIN o ON s.user_id = o.user_id""")
def field_distribution(spark, sf_dir):
    """Uniqueness, spread by population variance and outliers of the values of each group."""
    e = table(spark, sf_dir, "events").select("user_id", "value")
    sd = F.stddev_pop("value")
    spread = F.when(sd == 0, "zero").when(sd * sd < 10, "low").when(sd * sd < 1000, "medium").otherwise("high")
    ratio = F.round(F.countDistinct("value") / F.count(F.lit(1)), 6)
    s = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), ratio.alias("unique_ratio"), F.avg("value").alias("m"), sd.alias("sd"), spread.alias("spread"))
    far = F.count(F.when(F.abs(F.col("value") - F.col("m")) > 2 * F.col("sd"), 1))
    return e.join(s, "user_id").groupBy("user_id", "n", "unique_ratio", "spread").agg(far.alias("outliers"))


@query("""WITH l AS (UNPIVOT (SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_custkey::VARCHAR AS o_custkey FROM orders) ON o_orderkey, o_orderstatus, o_orderdate, o_custkey INTO NAME field VALUE v),
s AS (SELECT field, count(*) AS n, count(DISTINCT v) AS kinds, bool_and(regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS dated, avg(length(v)) AS chars FROM l GROUP BY field)
SELECT field, CASE WHEN dated THEN 'temporal' WHEN kinds > 0.9 * n THEN 'identifier' WHEN kinds <= 10 THEN 'status' WHEN chars > 50 THEN 'content' ELSE 'unknown' END AS meaning FROM s""")
def field_semantics(spark, sf_dir):
    """What each field holds, by ordered rules on its values."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.col("o_custkey").cast("string"))
    v = F.col("v")
    s = o.unpivot([], o.columns, "field", "v").where("v IS NOT NULL").groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("kinds"), F.bool_and(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")).alias("dated"), F.avg(F.length("v")).alias("chars")
    )
    kinds = F.col("kinds")
    meaning = F.when(F.col("dated"), "temporal").when(kinds > 0.9 * F.col("n"), "identifier").when(kinds <= 10, "status").when(F.col("chars") > 50, "content").otherwise("unknown")
    return s.select("field", meaning.alias("meaning"))


@query("""SELECT o_orderkey, '$.customer' AS path, o_custkey::VARCHAR AS value FROM orders WHERE o_custkey IS NOT NULL UNION ALL SELECT o_orderkey, '$.state.flags[0]', o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, '$.state.flags[1]', o_orderpriority FROM orders""")
def json_paths(spark, sf_dir):
    """Every leaf of a nested JSON text with its path."""
    flags = F.struct(F.array("o_orderstatus", "o_orderpriority").alias("flags"))
    body = F.to_json(F.struct(F.col("o_custkey").alias("customer"), flags.alias("state")))
    return nested.json_paths(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body")), "o_orderkey", "body", 4)


@query(f"SELECT page_id, len(regexp_extract_all(html, '{X.IMAGE_DATA}')) AS images, md5(regexp_replace(html, '{X.IMAGE_DATA}', '[image]', 'g')) AS text_md5 FROM pages")
def image_redaction(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count(html, F.lit(X.IMAGE_DATA)).alias("images"), F.md5(X.without_images(html).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, parts, parts >= 2 AS mixed FROM (SELECT doc_id, " + " + ".join(f"regexp_matches(text, '{p}')::INT" for p in X.MIXED.values()) + f" + (len(regexp_extract_all(text, '{X.SENTENCE}')) > 5)::INT AS parts FROM documents)")
def mixed_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_parts(F.col("text")).alias("parts")).select("doc_id", "parts", (F.col("parts") >= 2).alias("mixed"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
k AS (SELECT doc_id, pos, CASE {_CASES} ELSE 'plain' END AS kind FROM l),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS island FROM k)
SELECT doc_id, kind, min(pos) AS begins, max(pos) + 1 AS ends FROM i GROUP BY doc_id, kind, island""")
def content_sections(spark, sf_dir):
    """A text's lines as sections of one kind each; no shuffle."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.runs(X.line_kinds(F.col("text")))).alias("s"))
    return s.select("doc_id", F.col("s.value").alias("kind"), "s.begins", "s.ends")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
t AS (SELECT doc_id, pos, regexp_replace(l, '[0-9]+', '#', 'g') AS template FROM l),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, template ORDER BY pos) AS island FROM t)
SELECT doc_id, min(pos) AS begins, count(*) AS repeats, template FROM i GROUP BY doc_id, template, island HAVING count(*) > 1""")
def line_templates(spark, sf_dir):
    """Runs of lines that differ only in their numbers, as a template and a count."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.runs(F.transform(F.split("text", "\n"), X.template))).alias("r"))
    return t.select("doc_id", "r.begins", (F.col("r.ends") - F.col("r.begins")).alias("repeats"), F.col("r.value").alias("template")).where("repeats > 1")


@query(rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{X.SEGMENT_END}'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s) AS segments, len(list_filter(s, lambda x: regexp_matches(x, '{X.SALIENT}'))) AS salient, len(list_filter(s, lambda x: strlen(x) < 12)) AS short FROM s""")
def text_segments(spark, sf_dir):
    """Sentences and lines, those with numbers, capitals or dotted names, and those too short to tell much."""
    s = table(spark, sf_dir, "documents").select("doc_id", X.segments(F.col("text")).alias("s"))
    count = lambda f: F.size(F.filter("s", f))
    return s.select("doc_id", F.size("s").alias("segments"), count(lambda x: x.rlike(X.SALIENT)).alias("salient"), count(lambda x: F.octet_length(x) < 12).alias("short"))


_UNIMPORTANT = " AND ".join(f"NOT regexp_matches(lower(l), '(^|[^a-z0-9_])({'|'.join(ws)})([^a-z0-9_]|$)')" for ws in T.IMPORTANCE.values())


@query(rf"""WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, regexp_extract_all(text, '(?m)^([^ \t\n:]+):[0-9]+:', 1) AS files FROM documents)
SELECT doc_id, round(least(1.0::DOUBLE, len(regexp_extract_all(text, '[}}][ \t\n]*,'))::DOUBLE / 49), 6) AS json,
  CASE WHEN len(ls) < 50 THEN 0.0::DOUBLE ELSE round(0.5::DOUBLE * (1 - len(list_distinct(ls))::DOUBLE / len(ls)) + 0.5::DOUBLE * (len(list_filter(ls, lambda l: {_UNIMPORTANT}))::DOUBLE / len(ls)), 6) END AS log,
  CASE WHEN len(files) < 10 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (len(files)::DOUBLE / len(list_distinct(files)) - 1) / 10)), 6) END AS search FROM t""")
def bloat_estimates(spark, sf_dir):
    """What share of a text could go, judged as JSON, as a log and as search hits, over all its lines."""
    text = F.col("text")
    kinds = {"json": X.json_bloat(text), "log": X.log_bloat(text, T.importance), "search": X.search_bloat(text)}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.round(c, 6).alias(k) for k, c in kinds.items()])


_VOTES = {k: f"len(regexp_extract_all(html, '{p}'))" for k, p in X.LANGUAGE_VOTES.items()}


@query("WITH v AS (SELECT page_id, " + ", ".join(f'{v} AS "{k}"' for k, v in _VOTES.items()) + " FROM pages), m AS (SELECT *, greatest(" + ", ".join(f'"{k}"' for k in _VOTES) + """) AS most FROM v)
SELECT page_id, CASE WHEN most < 1 THEN NULL """ + " ".join(f"WHEN \"{k}\" = most THEN '{k}'" for k in _VOTES) + " END AS language FROM m")
def code_languages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.code_language(F.col("html"), 1).alias("language"))


_TAG_NAMES = "list_transform(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9_-]*)', 1), lambda t: lower(t))"


@query(f"SELECT page_id, len({_TAG_NAMES}) AS tags, len(list_filter({_TAG_NAMES}, lambda t: t NOT IN (" + ", ".join(f"'{t}'" for t in X.KNOWN_TAGS) + "))) AS custom FROM pages")
def custom_tags(spark, sf_dir):
    """How many of a page's tags are none of the markup's own."""
    names = table(spark, sf_dir, "pages").select("page_id", F.transform(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9_-]*)"), F.lit(1)), F.lower).alias("t"))
    return names.select("page_id", F.size("t").alias("tags"), F.size(F.filter("t", lambda t: ~t.isin(*X.KNOWN_TAGS))).alias("custom"))


_STATISTICS = {"digits": "[0-9]", "capitals": "[A-Z]", "commas": ",", "marks": "[.!?]", "lines": r"\n", "brackets": r"[(){}\[\]]"}


@query("SELECT doc_id, length(text) AS chars, len(ws) AS words, len(list_distinct(ws)) AS distinct_words, CASE WHEN len(ws) = 0 THEN 0.0::DOUBLE ELSE round(list_sum(list_transform(ws, lambda w: length(w)))::DOUBLE / len(ws), 6) END AS mean_word, "
       + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in _STATISTICS.items()) + f" FROM (SELECT doc_id, text, {_WORDS} AS ws FROM documents)")
def text_statistics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", T.words(F.col("text")).alias("ws"))
    mean = F.length(F.array_join("ws", "")) / F.size("ws")
    counts = [F.regexp_count("text", F.lit(p)).alias(k) for k, p in _STATISTICS.items()]
    sizes = [F.length("text").alias("chars"), F.size("ws").alias("words"), F.size(F.array_distinct("ws")).alias("distinct_words")]
    return d.select("doc_id", *sizes, F.when(F.size("ws") == 0, 0.0).otherwise(F.round(mean, 6)).alias("mean_word"), *counts)


def _cases(column: str, patterns: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{k}'" for k, p in patterns.items()) + f" ELSE '{otherwise}' END"


@query(f"SELECT conv_id, turn, {_cases('text', X.TASKS, 'other')} AS task, {_cases('text', X.ERROR_CLASSES, 'none')} AS error, regexp_matches(lower(text), '{X.RETRIEVED}') AS retrieved FROM conversations")
def message_classes(spark, sf_dir):
    """What a message asks for, which kind of error it tells of, and whether it carries retrieved text."""
    low = F.lower("text")
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", detect.first_match(low, X.TASKS, "other").alias("task"), detect.first_match(low, X.ERROR_CLASSES, "none").alias("error"), low.rlike(X.RETRIEVED).alias("retrieved"))


@query("""SELECT page_id, regexp_replace(url, '([?&][a-z_]+)=[^&#]*', '\\1=*', 'g') AS shape FROM pages""")
def anonymous_queries(spark, sf_dir):
    """Queries with their fields kept and their values hidden."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "([?&][a-z_]+)=[^&#]*", "$1=*").alias("shape"))


#: The kinds whose patterns both engines read; look-arounds are Java's.
_STATIC = {k: p for k, p in detect.VOLATILE.items() if "(?!" not in p and "(?<" not in p}


@query("SELECT conv_id, turn, md5(" + "".join("regexp_replace(" for _ in _STATIC) + "text" + "".join(f", '{p}', '', 'g')" for p in _STATIC.values()) + ") AS static_md5 FROM conversations")
def static_text(spark, sf_dir):
    """Texts without what changes between otherwise equal ones."""
    out = F.col("text")
    for p in _STATIC.values():
        out = F.regexp_replace(out, p, "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(out.cast("binary")).alias("static_md5"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type IN ('view', 'click')) AS hits, count(*) FILTER (event_type = 'view') AS whole, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id)
SELECT user_id, n, round(hits / n, 6) AS rate, CASE WHEN n < 5 THEN 15 WHEN hits / n > 0.5 THEN 50 WHEN hits / n > 0.2 THEN 30 ELSE 20 END AS items, (hits / n > 0.5 AND whole / greatest(1, hits) > 0.8) AS skip,
  round(least(0.95::DOUBLE, least(0.7::DOUBLE, n / 100.0::DOUBLE) + least(0.3::DOUBLE, 0.03::DOUBLE * kinds)), 6) AS confidence FROM s""")
def learned_recommendations(spark, sf_dir):
    """How much to keep for each key, from how often what was left out was asked for again, and how sure that is."""
    kind = F.col("event_type")
    count = lambda c: F.count(F.when(c, 1))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), count(kind.isin("view", "click")).alias("hits"), count(kind == "view").alias("whole"), F.countDistinct("event_type").alias("kinds")
    )
    n, rate = F.col("n"), F.col("hits") / F.col("n")
    items = F.when(n < 5, 15).when(rate > 0.5, 50).when(rate > 0.2, 30).otherwise(20)
    skip = (rate > 0.5) & (F.col("whole") / F.greatest(F.lit(1), F.col("hits")) > 0.8)
    sure = F.least(F.lit(0.95), F.least(F.lit(0.7), n / 100) + F.least(F.lit(0.3), 0.03 * F.col("kinds")))
    return s.select("user_id", "n", F.round(rate, 6).alias("rate"), items.alias("items"), skip.alias("skip"), F.round(sure, 6).alias("confidence"))


@query("""WITH f AS (SELECT *, sum((event_type <> 'error')::INT) OVER w AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, CASE WHEN event_type = 'error' THEN sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) ELSE 0 END AS failures FROM f),
o AS (SELECT *, max(ts) FILTER (failures >= 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM c)
SELECT event_id, coalesce(ts < opened + INTERVAL 6 HOUR, false) AS open FROM o""")
def circuit_breaker(spark, sf_dir):
    """Whether a key's breaker is open at each event: two failures in a row open it for six hours."""
    at = W.partitionBy("user_id").orderBy("ts", "event_id")
    failed = F.col("event_type") == "error"
    c = table(spark, sf_dir, "events").withColumn("run", F.sum((~failed).cast("int")).over(at))
    streak = F.sum(failed.cast("int")).over(W.partitionBy("user_id", "run").orderBy("ts", "event_id"))
    c = c.withColumn("failures", F.when(failed, streak).otherwise(0))
    opened = F.max(F.when(F.col("failures") >= 2, F.col("ts"))).over(at.rowsBetween(W.unboundedPreceding, -1))
    return c.withColumn("opened", opened).select("event_id", F.coalesce(F.col("ts") < F.col("opened") + F.expr("INTERVAL 6 HOURS"), F.lit(False)).alias("open"))


@query("""SELECT conv_id, count(*) AS parts, md5(string_agg(text, '' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id""")
def assembled_messages(spark, sf_dir):
    """Streamed parts put together in their order."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"), F.md5(text.cast("binary")).alias("text_md5"))


_GRAMS = "CASE WHEN len(ws) < n THEN [] ELSE list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' ')) END"


@query(f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS ws FROM conversations), g AS (SELECT conv_id, turn, n, unnest({_GRAMS}) AS gram FROM w, (VALUES (1), (2), (3), (4)) AS s(n)),
c AS (SELECT conv_id, turn, n, gram, count(*) AS k FROM g GROUP BY ALL),
m AS (SELECT a.conv_id, a.turn, a.n, sum(least(a.k, coalesce(b.k, 0)))::DOUBLE / sum(a.k) AS p FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.n = b.n AND a.gram = b.gram GROUP BY ALL)
SELECT conv_id, turn, round(exp(avg(ln(p))), 6) AS bleu FROM m WHERE p > 0 AND turn > 0 GROUP BY conv_id, turn""")
def bleu(spark, sf_dir):
    """Each turn against the one before it: the geometric mean of clipped precisions of one to four words that aren't 0."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("ws"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, F.lit(n)), " "))
    both = F.array(*[F.struct(F.lit(n).alias("n"), F.when(F.size("ws") >= n, of(n)).otherwise(F.array().cast("array<string>")).alias("gs")) for n in range(1, 5)])
    g = w.select("conv_id", "turn", F.explode(both).alias("s")).select("conv_id", "turn", "s.n", F.explode("s.gs").alias("gram"))
    c = g.groupBy("conv_id", "turn", "n", "gram").agg(F.count(F.lit(1)).alias("k"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), "n", "gram", F.col("k").alias("seen"))
    shared = F.sum(F.least("k", F.coalesce("seen", F.lit(0))))
    m = c.join(before.hint("merge"), ["conv_id", "turn", "n", "gram"], "left").groupBy("conv_id", "turn", "n").agg((shared / F.sum("k")).alias("p"))
    return m.where("p > 0 AND turn > 0").groupBy("conv_id", "turn").agg(F.round(F.exp(F.avg(F.log("p"))), 6).alias("bleu"))


@query("""WITH e AS (SELECT DISTINCT user_id AS a, (json_extract_string(props, '$.k'))::BIGINT AS b FROM events)
SELECT a, b FROM e WHERE a <> b AND NOT EXISTS (SELECT 1 FROM e r WHERE r.a = e.b AND r.b = e.a)""")
def without_contradictions(spark, sf_dir):
    """Claims a -> b whose opposite isn't claimed as well."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("a"), F.get_json_object("props", "$.k").cast("long").alias("b")).where("a <> b").distinct()
    return e.join(e.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti").select("a", "b")


@query("""WITH s AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, count(*) AS n, round(count(*) FILTER (event_id - before BETWEEN 1 AND 200)::DOUBLE / nullif(count(before), 0), 6) AS near_steps, count(*) >= 5 AND count(*) FILTER (event_id - before BETWEEN 1 AND 200)::DOUBLE / nullif(count(before), 0) > 0.8 AS sequential FROM s GROUP BY user_id""")
def sequential_fields(spark, sf_dir):
    """Whether a group's sorted ids go up in small steps for the most part."""
    step = F.col("event_id") - F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    share = F.count(F.when(F.col("step").between(1, 200), 1)) / F.count("step")
    s = table(spark, sf_dir, "events").withColumn("step", step).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), share.alias("share"))
    return s.select("user_id", "n", F.round("share", 6).alias("near_steps"), ((F.col("n") >= 5) & (F.col("share") > 0.8)).alias("sequential"))
