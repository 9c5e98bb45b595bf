"""Queries over agents' traffic: messages as blocks, logs, shell commands, memories, feedback of tools, recommendations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions import agents as A
from lodestream.functions import text as T
from lodestream.plans.registry import query, table


def _blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND text <> ''")
    return c.select("conv_id", "turn", A.block_kind(F.col("role"), F.col("text")).alias("kind"), T.size_tokens(F.col("text")).alias("tokens"), T.block_hash(F.col("text")).alias("hash"))


_BLOCKS = r"""b AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'system' WHEN role = 'tool' THEN 'tool_result' WHEN role = 'assistant' THEN 'assistant'
  WHEN regexp_matches(lower(text), '\[?(source|document|context|passage|chunk)( [0-9]+)?\]?:|retrieved (documents|context)|according to the (document|context)') THEN 'rag' WHEN role = 'user' THEN 'user' ELSE 'unknown' END AS kind,
  floor(length(text) / 4.0::DOUBLE + 0.5)::BIGINT AS tokens, substr(md5(text), 1, 16) AS hash FROM conversations WHERE text <> '')"""


@query(f"WITH {_BLOCKS} SELECT * FROM b")
def message_blocks(spark, sf_dir):
    """Messages as typed blocks with a token estimate, a content hash and their place."""
    return _blocks(spark, sf_dir)


@query(f"""WITH {_BLOCKS}, r AS (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id, hash ORDER BY turn) AS gap FROM b)
SELECT conv_id, kind, count(*) AS blocks, sum(tokens)::BIGINT AS tokens, coalesce(sum(CASE WHEN gap > 3 AND tokens >= 50 THEN tokens END), 0)::BIGINT AS read_again FROM r GROUP BY conv_id, kind""")
def conversation_breakdown(spark, sf_dir):
    """Blocks and tokens by kind; a block of 50 tokens and more that comes again after over three messages counts as read again."""
    gap = F.col("turn") - F.lag("turn").over(W.partitionBy("conv_id", "hash").orderBy("turn"))
    r = _blocks(spark, sf_dir).withColumn("gap", gap)
    again = F.coalesce(F.sum(F.when((F.col("gap") > 3) & (F.col("tokens") >= 50), F.col("tokens"))), F.lit(0))
    return r.groupBy("conv_id", "kind").agg(F.count(F.lit(1)).alias("blocks"), F.sum("tokens").alias("tokens"), again.alias("read_again"))


@query("""SELECT conv_id, sha256('sonnet' || chr(0) || substr(min_by(text, turn), 1, 512)) AS key FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def conversation_keys(spark, sf_dir):
    """A key that holds for a conversation's life: the model and the first 512 characters of its first user message."""
    first = F.min_by("text", "turn")
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(A.conversation_key(F.lit("sonnet"), first).alias("key"))


@query("""SELECT event_id, substr(md5(event_type || chr(0) || '{"k": ' || json_extract_string(props, '$.k') || '}'), 1, 16) AS key FROM events""")
def call_keys(spark, sf_dir):
    """A call's name and its arguments in canonical form, hashed."""
    k = F.from_json("props", "map<string,long>")
    names = F.array_sort(F.map_keys(k))
    pairs = F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('": '), F.element_at(k, n).cast("string")))
    canonical = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", A.call_key(F.col("event_type"), canonical).alias("key"))


@query("""WITH p AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, substr(sha256('{"messages": [{"content": ' || to_json(coalesce(before, '')) || ', "role": "user"}], "model": "m", "temperature": 0}'), 1, 32) AS key FROM p""")
def response_keys(spark, sf_dir):
    """The exact response cache's key: request fields as JSON with sorted keys."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(before, F.lit("")).alias("before"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("before").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    body = F.concat(F.lit('{"messages": [{"content": '), quoted, F.lit(', "role": "user"}], "model": "m", "temperature": 0}'))
    return c.select("conv_id", "turn", F.substring(F.sha2(body.cast("binary"), 256), 1, 32).alias("key"))


_LOG_FORMATS = {
    "pytest": ("=== FAILURES", "=== ERRORS", "=== test session", "=== short test summary", "PASSED [", "FAILED [", "ERROR [", "SKIPPED [", "collected "),
    "npm": ("npm ERR!", "npm WARN", "npm info", "npm http"), "cargo": ("Compiling ", "Finished ", "Running ", "warning: ", "error[E"),
    "jest": ("PASS ", "FAIL ", "Test Suites:"), "make": ("make[", "make:", "gcc ", "g++ ", "clang "),
}
_LOG_OF = "CASE doc_id % 6 WHEN 0 THEN 'collected 5 items' || chr(10) WHEN 1 THEN 'npm WARN old' || chr(10) || 'npm ERR! bad' || chr(10) WHEN 2 THEN 'Compiling x' || chr(10) || 'error[E01]' || chr(10) WHEN 3 THEN 'PASS a' || chr(10) || 'FAIL b' || chr(10) WHEN 4 THEN 'gcc -c x' || chr(10) ELSE '' END || text"


@query(f"""WITH t AS (SELECT doc_id, (string_split({_LOG_OF}, chr(10)))[1:100] AS ls FROM documents),
v AS (SELECT doc_id, """ + ", ".join("len(list_filter(ls, lambda l: " + " OR ".join(f"contains(l, '{m}')" for m in ms) + f")) AS {k}" for k, ms in _LOG_FORMATS.items()) + """ FROM t)
SELECT doc_id, CASE WHEN greatest(pytest, npm, cargo, jest, make) = 0 THEN 'generic' WHEN pytest = greatest(pytest, npm, cargo, jest, make) THEN 'pytest' WHEN npm = greatest(npm, cargo, jest, make) THEN 'npm' WHEN cargo = greatest(cargo, jest, make) THEN 'cargo' WHEN jest >= make THEN 'jest' ELSE 'make' END AS format FROM v""")  # fmt: skip
def log_formats(spark, sf_dir):
    """The kind of tool that wrote a log: the most votes among its first hundred lines, the first of equals."""
    heads = {0: "collected 5 items\n", 1: "npm WARN old\nnpm ERR! bad\n", 2: "Compiling x\nerror[E01]\n", 3: "PASS a\nFAIL b\n", 4: "gcc -c x\n"}
    head = F.lit("")
    for k, v in heads.items():
        head = F.when(F.col("doc_id") % 6 == k, v).otherwise(head)
    return table(spark, sf_dir, "documents").select("doc_id", A.log_format(F.concat(head, F.col("text"))).alias("format"))


_COMMANDS = ("cat src/a.py", "sed -n 1,20p b.txt", "rg foo src", "git status", "pytest -q tests", "cd x && head -5 y.md", "apply_patch <<EOF", "echo hi | wc -l", "rtk proxy cat z.c", "ls")
_SHELL = "(['cat src/a.py', 'sed -n 1,20p b.txt', 'rg foo src', 'git status', 'pytest -q tests', 'cd x && head -5 y.md', 'apply_patch <<EOF', 'echo hi | wc -l', 'rtk proxy cat z.c', 'ls'])[1 + event_id % 10]"
_CLASSED = f"""c AS (SELECT event_id, {_SHELL} AS command FROM events), k AS (SELECT event_id, command, CASE command WHEN 'cat src/a.py' THEN 'read' WHEN 'sed -n 1,20p b.txt' THEN 'read' WHEN 'rg foo src' THEN 'search' WHEN 'git status' THEN 'git' WHEN 'pytest -q tests' THEN 'build/test'
  WHEN 'cd x && head -5 y.md' THEN 'read' WHEN 'apply_patch <<EOF' THEN 'edit' WHEN 'echo hi | wc -l' THEN 'compound' WHEN 'rtk proxy cat z.c' THEN 'read' ELSE 'other' END AS category,
  CASE command WHEN 'cat src/a.py' THEN 'src/a.py' WHEN 'sed -n 1,20p b.txt' THEN 'b.txt' WHEN 'cd x && head -5 y.md' THEN 'y.md' WHEN 'rtk proxy cat z.c' THEN 'z.c' END AS path, command IN ('sed -n 1,20p b.txt', 'cd x && head -5 y.md') AS partial FROM c)"""


def _commands(spark, sf_dir):
    command = F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.col("event_id") % 10 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", command.alias("command"))
    return e.withColumn("c", A.command_class(F.col("command"))).select("event_id", "user_id", "value", "command", "c.*")


@query(f"WITH {_CLASSED} SELECT event_id, category, path, partial FROM k")
def command_classes(spark, sf_dir):
    """Shell commands by what they do, with the file that a read takes and whether it takes a part."""
    return _commands(spark, sf_dir).select("event_id", "category", "path", "partial")


@query(f"""WITH {_CLASSED}, r AS (SELECT k.category, e.value, e.user_id, k.path, row_number() OVER (PARTITION BY e.user_id, k.path ORDER BY k.event_id) AS nth FROM k JOIN events e ON e.event_id = k.event_id)
SELECT category, count(*) AS calls, round(sum(value::DECIMAL(28, 2))::DOUBLE, 2) AS bytes, count(*) FILTER (category = 'read' AND path IS NOT NULL AND nth > 1) AS rereads, max(value) AS largest FROM r GROUP BY category""")
def shell_audit(spark, sf_dir):
    """Calls and bytes by category, and how many reads take a file that its user has read before."""
    nth = F.row_number().over(W.partitionBy("user_id", "path").orderBy("event_id"))
    r = _commands(spark, sf_dir).withColumn("nth", nth)
    again = F.count(F.when((F.col("category") == "read") & F.col("path").isNotNull() & (F.col("nth") > 1), 1))
    return r.groupBy("category").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("value").cast("decimal(28,2)")).cast("double"), 2).alias("bytes"), again.alias("rereads"), F.max("value").alias("largest"))


@query("SELECT event_id, event_type IN ('error', 'view') OR event_type LIKE 'p%' OR event_type LIKE '%k' AS excluded FROM events")
def tool_exclusions(spark, sf_dir):
    """Names on a list of exact names and globs."""
    return table(spark, sf_dir, "events").select("event_id", A.matches_any(F.col("event_type"), ("error", "view", "p*", "*k")).alias("excluded"))


@query(r"""SELECT item_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) + 5 AS tokens, 4 AS bigrams FROM benchmark""")
def cjk_tokens(spark, sf_dir):
    """Words, and runs of CJK characters as pairs of neighbours."""
    b = table(spark, sf_dir, "benchmark")
    tokens = A.eval_tokens(F.concat("text", F.lit(" 漢字仮名 x1 カナ")))
    cjk = F.filter(tokens, lambda x: x.rlike(A.CJK))
    return b.select("item_id", F.size(tokens).alias("tokens"), F.size(cjk).alias("bigrams"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN date_trunc('second', ts)::TIMESTAMP END AS parsed FROM events")
def parsed_timestamps(spark, sf_dir):
    """ISO variants as UTC times; what is none gives null."""
    case = F.col("event_id") % 5
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(case == 0, F.concat(day, F.lit("T"), clock, F.lit("Z"))).when(case == 1, F.concat(day, F.lit(" "), clock)).when(case == 2, F.concat(later, F.lit("+02:00")))
        .when(case == 3, F.concat(day, F.lit("T"), clock, F.lit("+00:00"))).otherwise("no time")
    )
    return table(spark, sf_dir, "events").select("event_id", F.try_to_timestamp(text).alias("parsed"))


@query("""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
f AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(before, '[0-9]{2,}|[A-Z][a-z]{5,}')) AS facts, text FROM p WHERE before IS NOT NULL)
SELECT conv_id, turn, len(facts) AS facts, len(list_filter(facts, lambda x: NOT contains(text, x))) AS lost FROM f""")
def lost_facts(spark, sf_dir):
    """Facts of a text that the one after it lacks."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("before")).where("before IS NOT NULL")
    c = c.withColumn("facts", F.array_distinct(F.regexp_extract_all("before", F.lit("[0-9]{2,}|[A-Z][a-z]{5,}"), F.lit(0))))
    return c.select("conv_id", "turn", F.size("facts").alias("facts"), F.size(F.filter("facts", lambda x: ~F.contains(F.col("text"), x))).alias("lost"))


@query("""WITH h AS (SELECT event_type, user_id, value, value - lag(value) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS step FROM events)
SELECT event_type AS provider, count(*) AS requests, round(sum(CASE WHEN step >= 0 THEN value::DECIMAL(28, 2) ELSE 0 END)::DOUBLE, 2) AS reads, round(sum(CASE WHEN step IS NULL THEN value::DECIMAL(28, 2) ELSE 0 END)::DOUBLE, 2) AS writes, count(*) FILTER (step < 0) AS busts FROM h GROUP BY event_type""")
def prefix_cache_stats(spark, sf_dir):
    """By provider: what was read from a prefix that held, what was written first, and how often a prefix broke."""
    step = F.col("value") - F.lag("value").over(W.partitionBy("event_type", "user_id").orderBy("event_id"))
    h = table(spark, sf_dir, "events").withColumn("step", step)
    total = lambda when: F.round(F.sum(F.when(when, F.col("value").cast("decimal(28,2)")).otherwise(0)).cast("double"), 2)
    return h.groupBy(F.col("event_type").alias("provider")).agg(F.count(F.lit(1)).alias("requests"), total(F.col("step") >= 0).alias("reads"), total(F.col("step").isNull()).alias("writes"), F.count(F.when(F.col("step") < 0, 1)).alias("busts"))


@query("""WITH c AS (SELECT event_type, event_id, user_id, value, count(*) OVER o AS n, sum(value::DECIMAL(28, 2)) OVER o AS s FROM events WINDOW o AS (PARTITION BY event_type, user_id ORDER BY event_id))
SELECT event_type, user_id, event_id, n, s::DOUBLE / n AS mean, round(least(0.7::DOUBLE, n / 100.0::DOUBLE) + 0.03::DOUBLE, 4) AS confidence FROM c""")
def running_averages(spark, sf_dir):
    """A pattern's mean as it was learned, observation by observation, with the confidence that its number gives."""
    by = W.partitionBy("event_type", "user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").withColumn("n", F.count(F.lit(1)).over(by)).withColumn("s", F.sum(F.col("value").cast("decimal(28,2)")).over(by))
    confidence = F.least(F.lit(0.7), F.col("n") / 100) + 0.03
    return e.select("event_type", "user_id", "event_id", "n", (F.col("s").cast("double") / F.col("n")).alias("mean"), F.round(confidence, 4).alias("confidence"))


@query("""WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS compressions, count(*) FILTER (event_type = 'click') AS retrievals, count(*) FILTER (event_type = 'click' AND value > 20) AS full_retrievals FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id),
r AS (SELECT *, retrievals / nullif(compressions, 0)::DOUBLE AS rate, full_retrievals / nullif(retrievals, 0)::DOUBLE AS full_rate FROM s)
SELECT user_id, compressions, retrievals, round(least(1, greatest(0, 1 - 0.15::DOUBLE * full_retrievals - 0.05::DOUBLE * (retrievals - full_retrievals) + 0.02::DOUBLE * compressions)), 4) AS success,
  CASE WHEN compressions < 5 THEN 15 WHEN rate > 0.5 THEN CASE WHEN full_rate > 0.8 THEN 0 ELSE 50 END WHEN rate > 0.2 THEN 30 ELSE 15 END AS keep FROM r""")
def tool_feedback(spark, sf_dir):
    """A tool's cuts against what was fetched again: how well it does, and how many items its cuts should keep (0: don't cut)."""
    kind, value = F.col("event_type"), F.col("value")
    s = table(spark, sf_dir, "events").where(kind.isin("view", "click")).groupBy("user_id").agg(
        F.count(F.when(kind == "view", 1)).alias("compressions"), F.count(F.when(kind == "click", 1)).alias("retrievals"), F.count(F.when((kind == "click") & (value > 20), 1)).alias("full")
    )
    success = 1 - 0.15 * F.col("full") - 0.05 * (F.col("retrievals") - F.col("full")) + 0.02 * F.col("compressions")
    rate, full_rate = F.col("retrievals") / F.nullif("compressions", F.lit(0)), F.col("full") / F.nullif("retrievals", F.lit(0))
    keep = F.when(F.col("compressions") < 5, 15).when(rate > 0.5, F.when(full_rate > 0.8, 0).otherwise(50)).when(rate > 0.2, 30).otherwise(15)
    return s.select("user_id", "compressions", "retrievals", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), success)), 4).alias("success"), keep.alias("keep"))


@query(r"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
s AS (SELECT conv_id, length(text) / nullif(length(before), 0)::DOUBLE AS ratio, lower(trim(text)) = lower(trim(before)) AS same, floor(length(text) / 4.0::DOUBLE + 0.5) AS tokens FROM p WHERE before IS NOT NULL)
SELECT conv_id, count(*) AS cases, round(avg(same::INT), 6) AS pass_rate, round(avg(ratio), 6) AS mean_ratio, sum(tokens)::BIGINT AS tokens FROM s GROUP BY conv_id""")
def suite_totals(spark, sf_dir):
    """A suite's cases: how many pass, their mean ratio of lengths and their tokens."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "text", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("before")).where("before IS NOT NULL")
    same = (F.lower(F.trim("text")) == F.lower(F.trim("before"))).cast("int")
    ratio = F.length("text") / F.nullif(F.length("before"), F.lit(0))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(same), 6).alias("pass_rate"), F.round(F.avg(ratio), 6).alias("mean_ratio"), F.sum(T.size_tokens(F.col("text"))).alias("tokens"))


@query(r"""WITH e AS (SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '[A-Z][a-z]+[ \t\n]+[A-Z][a-z]+'), list_concat(regexp_extract_all(text, '[A-Z][a-z]+[A-Z][a-zA-Z]*'), regexp_extract_all(text, '[A-Z][A-Z_]{2,}'))))) AS entity FROM documents)
SELECT entity, count(*) AS documents, min(doc_id) AS first_id FROM e WHERE entity NOT IN ('THE', 'AND', 'BUT', 'FOR', 'NOT', 'WITH', 'FROM') AND length(entity) < 80 GROUP BY entity""")
def entities(spark, sf_dir):
    """Names that texts speak of: runs of capitalised words, identifiers in camel case or capitals."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(A.entities(F.col("text"))).alias("entity"))
    return found.groupBy("entity").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_id"))


@query(r"""WITH t AS (SELECT item_id, 'alpha' || item_id || ' uses beta' || (item_id % 7) || '. gamma requires delta' || (item_id % 3) || ' ' || text AS t FROM benchmark)
SELECT item_id, 'uses' AS relation, 'alpha' || item_id AS source, 'beta' || (item_id % 7) AS target FROM t UNION ALL SELECT item_id, 'requires', 'gamma', 'delta' || (item_id % 3) FROM t""")
def relationships(spark, sf_dir):
    """Who uses, requires, integrates with or depends on what, by the verb between two words."""
    head = F.concat(F.lit("alpha"), F.col("item_id"), F.lit(" uses beta"), F.col("item_id") % 7, F.lit(". gamma requires delta"), F.col("item_id") % 3, F.lit(" "))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(A.relations(F.concat(head, F.col("text")))).alias("r"))
    return b.select("item_id", "r.relation", "r.source", "r.target")


@query("""SELECT conv_id, turn, '[{"content":"fact ' || turn || '"}]' AS memories, md5(text) AS answer_md5 FROM conversations WHERE turn % 2 = 0
UNION ALL SELECT conv_id, turn, NULL, md5(text) FROM conversations WHERE turn % 2 <> 0""")
def inline_memories(spark, sf_dir):
    """Answers that carry a block of memories: what it holds, and the answer without it."""
    block = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('<memory>{"memories": [{"content": "fact '), F.col("turn"), F.lit('"}]}</memory>'))).otherwise("")
    c = table(spark, sf_dir, "conversations").withColumn("answer", F.concat("text", block))
    parts = A.memory_block(F.col("answer"))
    return c.select("conv_id", "turn", parts["memories"].alias("memories"), F.md5(parts["answer"].cast("binary")).alias("answer_md5"))


@query("""WITH e AS (SELECT DISTINCT user_id AS source, event_type AS relation, json_extract_string(props, '$.k')::BIGINT AS target FROM events)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY relation, target) AS place, 'user ' || source || ' --' || relation || '--> ' || target AS line FROM e WHERE source % 10 <> 3 AND target % 10 <> 3""")
def subgraph_text(spark, sf_dir):
    """A graph after the deletion of some nodes with all their relations, each relation as a line of its node's text."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("relation"), F.get_json_object("props", "$.k").cast("long").alias("target")).distinct()
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct().where("node % 10 = 3")
    left = e.join(nodes, F.col("source") == F.col("node"), "left_anti").join(nodes, F.col("target") == F.col("node"), "left_anti")
    line = F.concat(F.lit("user "), F.col("source"), F.lit(" --"), F.col("relation"), F.lit("--> "), F.col("target"))
    return left.select("source", F.row_number().over(W.partitionBy("source").orderBy("relation", "target")).alias("place"), line.alias("line"))


@query(r"""WITH q AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}')) AS qs, lag(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS sample FROM conversations),
w AS (SELECT *, list_distinct(regexp_extract_all(sample, '[a-z0-9_]{3,}')) AS ss FROM q WHERE sample IS NOT NULL AND len(qs) > 0)
SELECT conv_id, turn, round(least(1, 0.5::DOUBLE * len(list_filter(qs, lambda x: list_contains(ss, x))) / len(qs) + 0.2::DOUBLE * CASE WHEN len(ss) > 0 THEN len(list_filter(qs, lambda x: length(x) >= 4 AND contains(sample, x))) ELSE 0 END), 6) AS relevance FROM w""")
def context_relevance(spark, sf_dir):
    """How far a message asks for what the context before it held: shared words, and words that stand in it anywhere."""
    low = F.lower("text")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", low.alias("query"), F.lag(low).over(W.partitionBy("conv_id").orderBy("turn")).alias("sample"))
    c = c.withColumn("qs", A.keywords(F.col("query"))).where(F.col("sample").isNotNull() & (F.size("qs") > 0))
    return c.select("conv_id", "turn", F.round(A.relevance(F.col("qs"), F.col("sample")), 6).alias("relevance"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'view' THEN value::DECIMAL(28, 2) ELSE 0 END) AS reads, sum(CASE WHEN event_type = 'click' THEN value::DECIMAL(28, 2) ELSE 0 END) AS writes, count(*) FILTER (value > 40) AS slow FROM events GROUP BY user_id)
SELECT user_id, writes > 1.5 * reads AND reads + writes > 0 AS prefix_unstable, slow > 0.2 * n AS slow_requests, slow AS n_slow FROM s""")
def perf_recommendations(spark, sf_dir):
    """Advice by thresholds over a session's records: writes to a prefix cache above reads, many slow requests."""
    total = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value").cast("decimal(28,2)")).otherwise(0))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), total("view").alias("reads"), total("click").alias("writes"), F.count(F.when(F.col("value") > 40, 1)).alias("slow"))
    unstable = (F.col("writes") > 1.5 * F.col("reads")) & (F.col("reads") + F.col("writes") > 0)
    return s.select("user_id", unstable.alias("prefix_unstable"), (F.col("slow") > 0.2 * F.col("n")).alias("slow_requests"), F.col("slow").alias("n_slow"))


@query("""WITH m AS (SELECT doc_id, (['gpt-4o', 'claude-sonnet-4', 'gemini-pro', 'other'])[1 + doc_id % 4] AS model, floor(length(text) / 4.0::DOUBLE + 0.5)::BIGINT AS tokens, text FROM documents)
SELECT doc_id, CASE WHEN model LIKE '%sonnet%' THEN 'sonnet' WHEN model LIKE '%gpt%' THEN 'gpt' WHEN model LIKE '%gemini%' THEN 'gemini' ELSE 'other' END AS family, tokens, round(tokens / 128000.0::DOUBLE, 6) AS fill, substr(sha256(text), 1, 16) AS hash FROM m""")
def prompt_meta(spark, sf_dir):
    """Model family, how far the prompt fills a context of 128,000 tokens, and the prompt's hash."""
    model = F.element_at(F.array(*map(F.lit, ("gpt-4o", "claude-sonnet-4", "gemini-pro", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    tokens = T.size_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", A.family(model).alias("family"), tokens.alias("tokens"), F.round(tokens / 128000, 6).alias("fill"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("hash"))


@query("""SELECT event_id, format('{:.4g}', value) AS g FROM events""")
def formatted_numbers(spark, sf_dir):
    """Numbers with four significant digits."""
    return table(spark, sf_dir, "events").select("event_id", A.significant(F.col("value"), 4).alias("g"))


@query("""WITH s AS (SELECT user_id, event_id, ts, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS reply FROM events)
SELECT user_id, count(*) FILTER (value >= 30 AND epoch(reply) - epoch(ts) < value * 100) AS skipped, count(*) FILTER (value >= 30) AS long_outputs FROM s WHERE reply IS NOT NULL GROUP BY user_id""")
def skipped_outputs(spark, sf_dir):
    """Long outputs whose reply came sooner than they can be read."""
    s = table(spark, sf_dir, "events").withColumn("reply", F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("reply IS NOT NULL")
    waited = (F.unix_micros(F.col("reply").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    long = F.col("value") >= 30
    return s.groupBy("user_id").agg(F.count(F.when(long & (waited < F.col("value") * 100), 1)).alias("skipped"), F.count(F.when(long, 1)).alias("long_outputs"))


@query("""WITH l AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT user_id, event_type, count(*) AS repeats FROM l WHERE n >= 2 GROUP BY ALL),
b AS (SELECT user_id, event_type, count(*) / 100.0::DOUBLE AS weight FROM events GROUP BY ALL)
SELECT b.user_id, b.event_type, round(weight * CASE WHEN repeats IS NOT NULL THEN 1.5::DOUBLE ELSE 1 END, 6)::DOUBLE AS weight FROM b LEFT JOIN r ON b.user_id = r.user_id AND b.event_type = r.event_type""")
def loop_weights(spark, sf_dir):
    """Recommendations weigh more where the same call was seen to loop."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    # one aggregate of calls serves both sides
    calls = e.groupBy("user_id", "event_type", "k").agg(F.count(F.lit(1)).alias("n"))
    s = calls.groupBy("user_id", "event_type").agg((F.sum("n") / 100).alias("weight"), F.max("n").alias("most"))
    return s.select("user_id", "event_type", F.round(F.col("weight") * F.when(F.col("most") >= 2, 1.5).otherwise(1.0), 6).alias("weight"))
