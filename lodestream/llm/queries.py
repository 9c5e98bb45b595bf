"""The queries op1 to op13 and their SQL, each a thin form of an operator over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, divergence, exact, filters, fingerprint, langid, minhash, mixing, pieces, pii, quality, substring, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(ws[i:i + 12], ' ')) AS f FROM p
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM m WHERE f < doc_id
), g AS (
  SELECT doc_id, list(k) AS ks FROM c GROUP BY doc_id
), r AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ks), 0) AS n_removed,
    CASE WHEN ks IS NULL THEN ws ELSE list_select(ws, list_sort(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(ks, x)))) END AS kept
  FROM w LEFT JOIN g USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r
"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    identifier = langid.fit(langid.training_rows(docs))
    held_out = F.coalesce(~langid.learned_from("doc_id"), F.lit(False))
    out = langid.identify(docs, identifier).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.read_archives(warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
), r AS (
  SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first AS again FROM f
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM r
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.ordered(mixing.plan(_documents(spark, sf_dir)))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_position")


def _op7_sql(weights: tuple[float, ...] = (5, 2, 1)) -> str:
    """The schedules' ends enter as constants; a two-point schedule with integral 1 inverts in closed form."""
    ends = " ".join(f"WHEN {k} THEN {{'a': {a[1]!r}::DOUBLE, 'd': {b[1] - a[1]!r}::DOUBLE}}" for k, (a, b) in enumerate(mixing.ramp(weights)))
    weight = " ".join(f"WHEN {k} THEN {float(w)}::DOUBLE" for k, w in enumerate(weights))
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} AS slot FROM d GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, CASE slot {weight} END AS weight FROM s
), r AS (
  SELECT *, row_number() OVER w AS k, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
), f AS (
  SELECT min(k) AS k FROM r WHERE left_over / rest * weight <= cap
), t AS (
  SELECT r.source, source_size, slot,
    CASE WHEN (SELECT k FROM f) IS NULL OR r.k < (SELECT k FROM f) THEN cap
         ELSE (SELECT left_over / rest FROM r x WHERE x.k = (SELECT k FROM f)) * weight END AS target
  FROM r
), p AS (
  SELECT doc_id, size, source_size, target, slot, round(target)::BIGINT AS goal,
    (sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), g AS (
  SELECT *, greatest(0, least(size, goal - b)) AS g0, greatest(0, least(size, goal - source_size - b)) AS g1,
    greatest(0, least(size, goal - 2 * source_size - b)) AS g2, CASE slot {ends} END AS e
  FROM p
), h AS (
  SELECT *, CASE WHEN g0 > 0 THEN (b + g0 / 2.0::DOUBLE) / target END AS at0 FROM g
)
SELECT doc_id, size, source_size, target, g0 + g1 + g2 AS taken,
  CASE WHEN at0 IS NOT NULL THEN least(2 * at0 / (e.a + sqrt(greatest(e.a * e.a + 2 * e.d * at0, 0))), 1.0::DOUBLE) END AS first_position
FROM h
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.resolve_duplicates(_documents(spark, sf_dir), batches=2)  # the second meets what the first left in the index
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.sampled(_documents(spark, sf_dir), labels).withColumnRenamed("id", "doc_id")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pieces.encode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d
), t AS (
  SELECT row, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w
), k AS (
  SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 30
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL
), s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT *, 1 + (1000000000::HUGEINT * (c + 5)) // ((sum(c) OVER (PARTITION BY lang, source))::HUGEINT + 5 * v) AS p FROM s JOIN v USING (lang)
), l AS (
  SELECT lang, term, sum(c) AS c FROM s GROUP BY ALL
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // ((sum(c) OVER (PARTITION BY lang))::HUGEINT + 5 * v) AS q FROM l JOIN v USING (lang)
), x AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = filters.flagged(_documents(spark, sf_dir))
    return filters.interactions(flags, spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), m AS (
  SELECT doc_id, part,
    (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum([0] || bits[1:step - 1])::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_minhash": op2_minhash,
        "op3_substring": op3_substring,
        "op4_language": op4_language,
        "op5_fingerprints": op5_fingerprints,
        "op6_warc": op6_warc,
        "op7_mixing": op7_mixing,
        "op8_pii": op8_pii,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_quality": op10_quality,
        "op11_pieces": op11_pieces,
        "op12_divergence": op12_divergence,
        "op13_filters": op13_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring": OP3_SQL, "op6_warc": OP6_SQL, "op7_mixing": _op7_sql(), "op9_exact_dedup": OP9_SQL, "op12_divergence": OP12_SQL, "op13_filters": OP13_SQL}
