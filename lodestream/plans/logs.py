"""Queries over logs: which lines belong to stack traces, and logs cut to what tells."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators import logs, traces
from lodestream.plans.registry import query, table


def event_log(spark, sf_dir):
    """id, at, line: each user's events as a log; errors bring a trace of one of five makes."""
    e = table(spark, sf_dir, "events")
    n, u, x = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("value").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    frames = [
        [text("Traceback (most recent call last):"), text('  File "app_', u, '.py", line ', n), text("    call()"), text("ValueError: ", x), text("")],
        [text("    at run (/srv/app.js:", n, ":5)"), text("    at next (/srv/app.js:", u, ":15)")],
        [text("\tat com.acme.Run$1.go(Run.java:", n, ")"), text("\tat com.acme.Main.main(Main.java)")],
        [text("  --> src/main.rs:", n, ":5"), text("")],
        [text(u, ": 0x", F.lower(F.hex("event_id")), " main"), text(" 2: 0xff")],
    ]
    more = F.when(F.col("event_id") % 7 == 0, F.array(text("done"))).otherwise(F.array().cast("array<string>"))
    for k, made in enumerate(frames):
        more = F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 == k), F.array(*made)).otherwise(more)
    head = text(F.when(F.col("event_type") == "error", "ERROR ").otherwise("INFO "), F.col("event_type"), " ", n)
    lines = e.select(F.col("user_id").alias("id"), "event_id", F.posexplode(F.concat(F.array(head), more)).alias("k", "line"))
    return lines.select("id", (F.row_number().over(W.partitionBy("id").orderBy("event_id", "k")) - 1).cast("long").alias("at"), "line")


_EVENT_LOG = r"""e AS (SELECT user_id, event_id, [CASE WHEN event_type = 'error' THEN 'ERROR ' ELSE 'INFO ' END || event_type || ' ' || event_id] || CASE
  WHEN event_type = 'error' AND event_id % 5 = 0 THEN ['Traceback (most recent call last):', '  File "app_' || user_id || '.py", line ' || event_id, '    call()', 'ValueError: ' || value, '']
  WHEN event_type = 'error' AND event_id % 5 = 1 THEN ['    at run (/srv/app.js:' || event_id || ':5)', '    at next (/srv/app.js:' || user_id || ':15)']
  WHEN event_type = 'error' AND event_id % 5 = 2 THEN [chr(9) || 'at com.acme.Run$1.go(Run.java:' || event_id || ')', chr(9) || 'at com.acme.Main.main(Main.java)']
  WHEN event_type = 'error' AND event_id % 5 = 3 THEN ['  --> src/main.rs:' || event_id || ':5', '']
  WHEN event_type = 'error' AND event_id % 5 = 4 THEN [user_id || ': 0x' || lower(hex(event_id)) || ' main', ' 2: 0xff']
  WHEN event_id % 7 = 0 THEN ['done'] ELSE []::VARCHAR[] END AS ls FROM events),
x AS (SELECT user_id AS id, event_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM e),
l AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY event_id, k) - 1 AS p, line FROM x)"""


@query(rf"""WITH RECURSIVE {_EVENT_LOG}, b AS (SELECT *, ltrim(line, ' ' || chr(9)) AS bare FROM l),
s AS (SELECT *, CASE WHEN bare LIKE 'Traceback (most recent call last)%' OR regexp_matches(bare, '^File ".*", line .*[0-9]$') THEN 'python'
    WHEN regexp_matches(bare, '^at .*:[0-9]+:[0-9]') AND contains(bare, '(') AND contains(bare, ')') THEN 'js' WHEN regexp_matches(bare, '^at [A-Za-z0-9._$]+\(') THEN 'java'
    WHEN regexp_matches(bare, '^--> .*:[0-9]+:[0-9]') THEN 'rust' WHEN regexp_matches(bare, '^[0-9]+: *0x[0-9a-fA-F]') THEN 'go' END AS opens FROM b),
r AS (
  SELECT id, p, opens AS make, CASE WHEN opens IS NOT NULL THEN 1 END AS nth FROM s WHERE p = 0
  UNION ALL
  SELECT id, p, CASE WHEN goes THEN make ELSE opens END, CASE WHEN goes THEN nth + 1 WHEN opens IS NOT NULL THEN 1 END FROM (
    SELECT s.id, s.p, s.opens, r.make, r.nth, r.make IS NOT NULL AND r.nth < 20 AND (s.line = '' OR CASE r.make
      WHEN 'python' THEN s.line[1] IN (' ', chr(9)) OR regexp_matches(s.bare, '^(Traceback|File |During handling|The above exception)') OR regexp_matches(s.bare, '^[A-Z]')
      WHEN 'rust' THEN s.bare LIKE '--> %' WHEN 'go' THEN regexp_matches(s.bare, '^[0-9]') ELSE s.bare LIKE 'at %' END) AS goes
    FROM r JOIN s ON s.id = r.id AND s.p = r.p + 1)
)
SELECT id, p AS "at", make AS trace, nth FROM r""")
def log_traces(spark, sf_dir):
    """Which lines of each user's log belong to a stack trace, of what make, and which of its lines they are."""
    return traces.trace_lines(event_log(spark, sf_dir))


@query()
def compressed_logs(spark, sf_dir):
    """Documents as logs: those of fifty lines or more cut to errors, warnings, traces and summaries with what surrounds them."""
    return logs.compressed(table(spark, sf_dir, "documents"), "doc_id", "text")
