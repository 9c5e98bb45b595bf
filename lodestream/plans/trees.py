"""Queries over arrays cut by how many items they should keep, tables inferred from objects, and whole JSON documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators import adaptive, compressors, nested, tables, trees
from lodestream.plans.registry import query, table
from lodestream.session import written

_WORDS = "|".join(["error", "exception", "failed", "failure", "critical", "fatal", "crash", "panic", "abort", "timeout", "denied", "rejected"])
_BITS = ", ".join(f"sum((h >> {k}) & 1) AS s{k}" for k in range(64))
_HASH = " + ".join(f"CASE WHEN 2 * s{k} > m THEN {1 << k}::UBIGINT ELSE 0 END" for k in range(64))
_LINES = "i AS (SELECT doc_id AS a, unnest(string_split(text, chr(10))) AS item, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents)"
#: Hashes of the items i (a, p, item) of arrays with more than eight, and the pass in order that finds first representatives.
_ALIKE = f"""size AS (SELECT a, count(*) AS n FROM i GROUP BY a), big AS (SELECT i.* FROM i JOIN size USING (a) WHERE n > 8),
gram AS (SELECT a, p, unnest(list_transform(range(1, greatest(1, length(item) - 3) + 1), lambda x: substr(lower(item), x, 4))) AS g FROM big),
vote AS (SELECT a, p, count(*) AS m, {_BITS} FROM (SELECT a, p, ('0x' || substr(md5(g), 1, 16))::UBIGINT AS h FROM gram) GROUP BY a, p),
hash AS (SELECT a, p, ({_HASH})::UBIGINT AS h FROM vote),
reps AS (SELECT a, list_reduce(list([h] ORDER BY p), lambda r, x: CASE WHEN len(list_filter(r, lambda c: bit_count(xor(c, x[1])::BIT) <= 3)) > 0 THEN r ELSE r || x END) AS r FROM hash GROUP BY a)"""
#: k of each array, without the deflating step.
_K = f"""{_ALIKE},
word AS (SELECT a, p, list_filter(regexp_split_to_array(lower(item), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM big),
pair AS (SELECT a, p, unnest(CASE WHEN len(ws) < 2 THEN [coalesce(ws[1], '') || ' '] ELSE list_transform(range(1, len(ws)), lambda x: ws[x] || ' ' || ws[x + 1]) END) AS w FROM word),
new AS (SELECT a, p, count(*) AS c FROM (SELECT a, w, min(p) AS p FROM pair GROUP BY a, w) GROUP BY a, p),
curve AS (SELECT big.a, big.p, sum(coalesce(c, 0)) OVER (PARTITION BY big.a ORDER BY big.p)::BIGINT AS y FROM big LEFT JOIN new ON big.a = new.a AND big.p = new.p),
rise AS (SELECT a, p, y, min(y) OVER w AS lo, max(y) OVER w AS hi, count(*) OVER w AS n FROM curve WINDOW w AS (PARTITION BY a)),
gain AS (SELECT *, (y - lo) / nullif(hi - lo, 0) - p / (n - 1) AS d FROM rise), top AS (SELECT *, max(d) OVER (PARTITION BY a) AS best FROM gain),
bend AS (SELECT a, CASE WHEN max(hi) = min(lo) THEN 1 WHEN max(best) >= 0.05::DOUBLE THEN 1 + min(p) FILTER (d = best) END AS knee FROM top GROUP BY a),
known AS (SELECT size.a, n, len(r) AS clusters, knee, greatest(3, floor(n * (0.3::DOUBLE + 0.7::DOUBLE * (len(r) / n)))) AS least FROM size LEFT JOIN reps USING (a) LEFT JOIN bend USING (a)),
k AS (SELECT a, n, clusters, knee, (CASE WHEN n <= 8 THEN n WHEN clusters <= 3 THEN least(greatest(3, clusters), {{cap}})
  ELSE least(greatest(3, CASE WHEN knee IS NULL THEN least WHEN clusters / n > 0.7::DOUBLE THEN greatest(knee, least) ELSE knee END), {{cap}}) END)::BIGINT AS k FROM known)"""
_EVEN = "greatest(1, CASE WHEN k * {0} % 1 = 0.5 THEN 2 * round(k * {0} / 2) ELSE round(k * {0}) END)::BIGINT"
#: Which items of r (a, p, item, must, extra) stay, given k.
_CUT = f"""e AS (SELECT r.*, n, k, least({_EVEN.format("0.3")}, k) AS ff, least({_EVEN.format("0.15")}, k - least({_EVEN.format("0.3")}, k)) AS ll FROM r JOIN k USING (a)),
y AS (SELECT *, must OR p < ff OR p >= n - ll AS kept FROM e),
z AS (SELECT *, greatest(k - sum(kept::INT) OVER w, 0) AS room, k + sum(extra) OVER w - sum(kept::INT) OVER w AS places FROM y WINDOW w AS (PARTITION BY a)),
s AS (SELECT *, room > 0 AND n > 8 AND NOT kept AND p % greatest(1, (n - 1) // (room + 1)) = 0 AS hit FROM z),
h AS (SELECT *, {{distinct}} AS fresh FROM s), v AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY a ORDER BY p) AS nth FROM h)
SELECT a AS {{key}}, p AS pos, CASE WHEN n <= 8 THEN 'whole' WHEN must THEN 'marked' WHEN kept THEN 'edge' WHEN fresh AND nth <= places THEN 'stride' ELSE 'dropped' END AS why FROM v"""
_FRESH = "hit AND NOT max(kept::INT) OVER (PARTITION BY a, item) = 1 AND p = min(CASE WHEN hit THEN p END) OVER (PARTITION BY a, item)"


def _lines(spark, sf_dir):
    """Each document's lines as an array."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("array"), F.posexplode(F.split("text", "\n")).alias("pos", "item"))
    return lines.withColumn("pos", F.col("pos").cast("long"))


def _values(spark, sf_dir):
    """Each user's values as an array of numbers."""
    pos = (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("array"), pos.alias("pos"), F.col("value").alias("x"), F.col("value").cast("string").alias("item"))


@query(f"""WITH {_LINES}, {_ALIKE}
SELECT a AS doc_id, p AS pos, list_position(l, list_filter(r, lambda c: bit_count(xor(c, h)::BIT) <= 3)[1]) - 1 AS representative
FROM hash JOIN reps USING (a) JOIN (SELECT a, list(h ORDER BY p) AS l FROM hash GROUP BY a) USING (a)""")
def line_clusters(spark, sf_dir):
    """Lines that are alike within a document: each stands with the first representative that it is close to."""
    lines = _lines(spark, sf_dir)
    large = lines.groupBy("array").agg(F.count("*").alias("n")).where(F.col("n") > adaptive.WHOLE).select("array")
    found = adaptive.clusters(lines.join(large.hint("merge"), "array", "left_semi"))
    return found.select(F.col("array").cast("long").alias("doc_id"), "pos", "representative")


@query(f"WITH {_LINES}, {_K.format(cap='n')} SELECT a AS doc_id, n, clusters, knee, k FROM k")
def adaptive_k(spark, sf_dir):
    """How many lines each document should keep, by clusters and by the bend of its curve of distinct pairs."""
    return adaptive.optimal_k(_lines(spark, sf_dir), deflate=False).select(F.col("array").cast("long").alias("doc_id"), "n", "clusters", "knee", "k")


@query()
def deflated_k(spark, sf_dir):
    """As adaptive_k, raised where the first k lines deflate otherwise than the whole."""
    return adaptive.optimal_k(_lines(spark, sf_dir)).select(F.col("array").cast("long").alias("doc_id"), "n", "clusters", "knee", "k")


@query(f"""WITH {_LINES}, {_K.format(cap='15')}, q AS (SELECT a, avg(length(item)) AS m, stddev_samp(length(item)) AS sd FROM i GROUP BY a),
f AS (SELECT i.*, regexp_matches(lower(item), '{_WORDS}') AS error, coalesce(sd > 0 AND abs(length(item) - m) > 2 * sd, false) AS odd FROM i JOIN q USING (a)),
r AS (SELECT a, p, item, error OR odd AS must, error::INT + odd::INT AS extra FROM f), {_CUT.format(key='doc_id', distinct=_FRESH)}""")
def string_samples(spark, sf_dir):
    """Each document's lines as an array of strings cut to its own k: errors, odd lengths, both ends and an even stride stay."""
    lines = _lines(spark, sf_dir)
    budgets = adaptive.optimal_k(lines, max_k=trees.MOST_ITEMS, deflate=False)
    odd = adaptive.away(lines.withColumn("x", F.length("item").cast("double")), "x").withColumn("error", F.lower("item").rlike("|".join(trees.ERROR_KEYWORDS)))
    marked = odd.select("array", "pos", "item", (F.col("error") | F.col("away")).alias("must"), (F.col("error").cast("int") + F.col("away").cast("int")).alias("extra"))
    return adaptive.sampled(marked, budgets).select(F.col("array").cast("long").alias("doc_id"), "pos", "why")


@query(f"""WITH i AS (SELECT user_id AS a, value AS x, value::VARCHAR AS item, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events), {_K.format(cap='15')},
q AS (SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS sd, count(*) OVER w AS c, avg(x) OVER (PARTITION BY a ORDER BY p ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before,
  avg(x) OVER (PARTITION BY a ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS after FROM i WINDOW w AS (PARTITION BY a)),
f AS (SELECT *, coalesce(sd > 0 AND abs(x - m) > 2 * sd, false) AS odd, coalesce(c > 10 AND p >= 5 AND p < c - 5 AND sd > 0 AND abs(after - before) > 2 * sd, false) AS turn FROM q),
r AS (SELECT a, p, item, odd OR turn AS must, odd::INT AS extra FROM f), {_CUT.format(key='user_id', distinct='hit')}""")
def number_samples(spark, sf_dir):
    """Each user's values as an array of numbers cut to its own k: outliers, change points, both ends and an even stride stay."""
    values = _values(spark, sf_dir)
    budgets = adaptive.optimal_k(values.select("array", "pos", "item"), max_k=trees.MOST_ITEMS, deflate=False)
    odd = adaptive.away(values, "x")
    turns = adaptive.changes(odd, "x").withColumn("turn", F.lit(True))
    marked = odd.join(turns.hint("merge"), ["array", "pos"], "left").select("array", "pos", "item", (F.col("away") | F.coalesce("turn", F.lit(False))).alias("must"), F.col("away").cast("int").alias("extra"))
    return adaptive.sampled(marked, budgets, distinct=False).select(F.col("array").cast("long").alias("user_id"), "pos", "why")


def _cells(spark, sf_dir):
    """(cells, rows) of each user's events as an array of objects, some of which lack a field."""
    record = F.struct("event_id", "event_type", "value", F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("props"))
    at = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("table"), at.cast("long").alias("at"), F.to_json(record).alias("item"))
    return tables.cells(e, "table", "at", "item"), e.select("table", "at")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, CASE WHEN event_id % 5 <> 0 THEN json_extract(props, '$.k') END AS k FROM events),
c AS (SELECT user_id, count(*) AS n, count(k) AS ks,
  string_agg(event_id || ',' || event_type || ',' || value || ',' || coalesce(k::VARCHAR, ''), chr(10) ORDER BY p) AS body FROM e GROUP BY user_id)
SELECT user_id, n AS lines, '[' || n || ']{event_id:int,event_type:string,value:float'
  || CASE WHEN ks = 0 THEN '}' WHEN ks < n THEN ',props.k:int?}' ELSE ',props.k:int}' END AS header, md5(body) AS body_md5
FROM c WHERE ks > 0 AND ks < n""")
def table_compaction(spark, sf_dir):
    """Each user's events as a table: columns, types and which may lack a value are told from the objects, and a field
    of like objects opens into columns of its own."""
    cells, rows = _cells(spark, sf_dir)
    heads, lines = tables.table_lines(cells, rows)
    digests = compressors.line_digests(lines, "table", "at", "line").select(F.col("group").alias("table"), F.col("md5").alias("body_md5"))
    return heads.join(digests, "table").where(F.contains("header", F.lit("?"))).select(F.col("table").cast("long").alias("user_id"), F.col("n").alias("lines"), "header", "body_md5")


def event_documents(spark, sf_dir):
    """id, text: each user's events as a nested JSON document, with JSON in strings and a trail of values."""
    e = table(spark, sf_dir, "events")
    one = F.struct("event_id", "event_type", "value", "props")
    by_user = e.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("events"))
    values = F.transform("events", lambda x: x["value"])
    inner = F.struct(F.transform("events", lambda x: x["event_type"]).alias("kinds"), F.to_json(F.struct(values.alias("values"))).alias("raw"))
    return by_user.select(F.col("user_id").alias("id"), F.to_json(F.struct("user_id", "events", inner.alias("trail"))).alias("text"))


def conversation_documents(spark, sf_dir):
    """id, text: each conversation as a JSON document, its turns as objects and what was said as one more array."""
    c = table(spark, sf_dir, "conversations")
    by_conv = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    said = F.transform("turns", lambda x: F.substring_index(x["text"], ".", 1))
    return by_conv.select(F.col("conv_id").alias("id"), F.to_json(F.struct("conv_id", "turns", said.alias("said"))).alias("text"))


def _crushed(docs):
    docs = written(docs, "documents")
    out, _ = trees.crushed(docs, "id", "text")
    sizes = docs.select(F.col("id").cast("string").alias("doc"), F.octet_length("text").alias("bytes_in"))
    bytes_out, digest = F.octet_length("crushed").alias("bytes_out"), F.md5(F.col("crushed").cast("binary")).alias("crushed_md5")
    return out.join(sizes, "doc").select(F.col("doc").cast("long").alias("id"), "changed", "bytes_in", bytes_out, digest)


@query()
def crushed_events(spark, sf_dir):
    """Nested documents of events, crushed to any depth."""
    return _crushed(event_documents(spark, sf_dir))


@query()
def crushed_conversations(spark, sf_dir):
    """Conversations as JSON documents, crushed: long texts become markers, what was said is cut."""
    return _crushed(conversation_documents(spark, sf_dir))


@query("""WITH a AS (SELECT event_id, event_type, value, props, json_extract_string(props, '$.k') AS k FROM events),
t AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '[]' WHEN 1 THEN '[' || props || ',' || props || ']' WHEN 2 THEN '["' || event_type || '","x"]'
  WHEN 3 THEN '[' || k || ',' || value || ']' WHEN 4 THEN '[[' || k || '],[]]'
  WHEN 5 THEN '[' || (value > 50)::VARCHAR || ',true]' WHEN 6 THEN '[null,null]' WHEN 7 THEN '[' || k || ',"' || k || '"]' ELSE props END AS s FROM a),
i AS (SELECT event_id, unnest(json_extract(s, '$[*]')) AS x FROM t WHERE json_type(s) = 'ARRAY'),
k AS (SELECT event_id, CASE json_type(x) WHEN 'OBJECT' THEN 'dicts' WHEN 'ARRAY' THEN 'nested' WHEN 'VARCHAR' THEN 'strings'
  WHEN 'BOOLEAN' THEN 'bools' WHEN 'NULL' THEN 'mixed' ELSE 'numbers' END AS kind FROM i)
SELECT t.event_id, CASE WHEN count(kind) = 0 THEN 'empty' WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS kind
FROM t LEFT JOIN k USING (event_id) WHERE json_type(s) = 'ARRAY' GROUP BY t.event_id""")
def array_kinds(spark, sf_dir):
    """What JSON arrays hold, told from all their items; the arrays are made from events' columns."""
    k, value = F.get_json_object("props", "$.k"), F.col("value").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [
        text("[]"), text("[", F.col("props"), ",", F.col("props"), "]"), text('["', F.col("event_type"), '","x"]'), text("[", k, ",", value, "]"), text("[[", k, "],[]]"),
        text("[", (F.col("value") > 50).cast("string"), ",true]"), text("[null,null]"), text("[", k, ',"', k, '"]'), F.col("props"),
    ]
    made = forms[-1]
    for j, form in enumerate(forms[:-1]):
        made = F.when(F.col("event_id") % len(forms) == j, form).otherwise(made)
    return nested.array_kinds(table(spark, sf_dir, "events").select("event_id", made.alias("text")), "event_id", "text")
