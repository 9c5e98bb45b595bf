"""Queries over diffs, memories that are merged, an index of vectors, and reads that later ones cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import ann, diffs, memory, similarity
from lodestream.plans.registry import query, table

_EACH = 8  # lines of either side in a hunk


def document_diffs(spark, sf_dir):
    """id, text: how each document turns into the next by id, as a unified diff; of every third the counts are wrong."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("o"), "source")
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("o").alias("n"))
    both = d.join(n, "doc_id").withColumn("last", F.greatest(F.size("o"), F.size("n")) - 1)

    def hunk(k):
        old, new = F.slice("o", k * _EACH + 1, _EACH), F.slice("n", k * _EACH + 1, _EACH)

        def line(j):
            a, b = F.get(old, j), F.get(new, j)
            changed = F.filter(F.array(F.concat(F.lit("-"), a), F.concat(F.lit("+"), b)), lambda x: x.isNotNull())
            return F.when(a == b, F.array(F.concat(F.lit(" "), a))).otherwise(changed)

        at = (k * _EACH + 1).cast("string")
        wrong = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
        header = F.concat(F.lit("@@ -"), at, F.lit(","), (F.size(old) + wrong).cast("string"), F.lit(" +"), at, F.lit(","), F.size(new).cast("string"), F.lit(" @@"))
        return F.concat(F.array(header), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_EACH - 1)), line)))

    hunks = F.flatten(F.transform(F.sequence(F.lit(0), F.expr(f"last div {_EACH}").cast("int")), hunk))
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    head = F.array(F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path), F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path))
    return both.select(F.col("doc_id").alias("id"), F.array_join(F.concat(head, hunks), "\n").alias("text"))


_DIFFS = f"""d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS o FROM documents), b AS (SELECT d.doc_id, d.o, e.o AS n FROM d JOIN d e ON e.doc_id = d.doc_id + 1),
p AS (SELECT doc_id, o, n, unnest(range(1, greatest(len(o), len(n)) + 1)) AS i FROM b), l AS (SELECT doc_id, (i - 1) // {_EACH} AS hunk, o[i] AS x, n[i] AS y FROM p),
h AS (SELECT doc_id, hunk, count(x) AS old_lines, count(y) AS told_new, count(*) FILTER (x = y) AS same, count(*) FILTER (x IS NOT NULL AND x IS DISTINCT FROM y) AS gone,
  count(*) FILTER (y IS NOT NULL AND x IS DISTINCT FROM y) AS new,
  count(*) FILTER (x IS DISTINCT FROM y AND x LIKE '--%') AS odd_gone, count(*) FILTER (x IS DISTINCT FROM y AND y LIKE '++%') AS odd_new
  FROM l GROUP BY ALL)"""


@query(f"WITH {_DIFFS} SELECT doc_id, bool_and(old_lines + (doc_id % 3 = 0)::INT = same + gone AND told_new = same + new) AS diff FROM h GROUP BY doc_id")
def diff_detection(spark, sf_dir):
    """Which texts are unified diffs whose hunks have the lines that they count."""
    return diffs.detected(document_diffs(spark, sf_dir), "id", "text").withColumnRenamed("id", "doc_id")


@query(f"""WITH {_DIFFS},
f AS (SELECT doc_id, count(*) AS hunks, sum(new - odd_new) AS additions, sum(gone - odd_gone) AS deletions, 3 + count(*) + sum(same + gone + new) AS lines FROM h GROUP BY doc_id)
SELECT doc_id, (lines >= 50)::BIGINT AS files, CASE WHEN lines >= 50 THEN additions ELSE 0 END::BIGINT AS additions, CASE WHEN lines >= 50 THEN deletions ELSE 0 END::BIGINT AS deletions,
  CASE WHEN lines >= 50 THEN least(hunks, 10) ELSE 0 END::BIGINT AS hunks_kept, CASE WHEN lines >= 50 THEN greatest(hunks - 10, 0) ELSE 0 END::BIGINT AS hunks_omitted FROM f""")
def compressed_diffs(spark, sf_dir):
    """Diffs cut to what changed: how many hunks stay of each."""
    out = diffs.compressed(document_diffs(spark, sf_dir), "id", "text")
    return out.select(F.col("id").alias("doc_id"), "files", "additions", "deletions", "hunks_kept", "hunks_omitted")


@query()
def merged_memories(spark, sf_dir):
    """Documents as memories: like ones merged in order, the most important text staying with the sources of all."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "text", (F.xxhash64("doc_id") % 10).alias("importance"), F.array("source", "lang").alias("refs"), F.length("text").alias("uses"))
    out = similarity.merged(rows, "doc_id", "text", "importance", "refs", "uses", 0.7)
    return out.select("leader", F.col("id").alias("doc_id"), "importance", F.array_join("references", ",").alias("references"), "uses", "members")


@query()
def approximate_top_k(spark, sf_dir):
    """The ten vectors most similar to each whose id is divisible by 50, by an inverted-file index over all of them."""
    v = table(spark, sf_dir, "embeddings")
    return ann.VectorIndex.build(v, "vec_id", "embedding").nearest(v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@query("""WITH o AS (SELECT event_id, user_id, 'f' || (event_id % 3) AS path, CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'edit' ELSE 'read' END AS kind,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id * 7 % 50 END AS b, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 10 + event_id % 40 END AS n FROM events),
r AS (SELECT *, coalesce(b, 0) AS lo, CASE WHEN b IS NULL THEN 4611686018427387904 ELSE b + n END AS hi FROM o)
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM r x WHERE x.kind = 'edit' AND x.user_id = r.user_id AND x.path = r.path AND x.event_id > r.event_id) THEN 'stale'
  WHEN EXISTS (SELECT 1 FROM r x WHERE x.kind = 'read' AND x.user_id = r.user_id AND x.path = r.path AND x.event_id > r.event_id
    AND x.lo <= r.lo AND x.hi >= r.hi) THEN 'superseded' ELSE 'fresh' END AS state
FROM r WHERE kind = 'read'""")
def covered_reads(spark, sf_dir):
    """Events as reads and edits of files: which reads an edit or a covering read follows."""
    e = table(spark, sf_dir, "events")
    some = F.col("event_id") % 11 != 0
    kind = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0), "edit").otherwise("read")
    path = F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string"))
    ops = e.select("event_id", "user_id", path.alias("path"), kind.alias("kind"), F.when(some, F.col("event_id") * 7 % 50).alias("offset"), F.when(some, 10 + F.col("event_id") % 40).alias("limit"))
    return memory.read_states(ops, "user_id", "path", "event_id").select("event_id", "state")
