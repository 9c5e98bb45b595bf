"""Shorter forms of logs, search hits, diffs, prose, pages and JSON arrays.

Documents are taken apart into rows (lines, hunks, segments, items), chosen from by windows, and put together again;
what is dropped stays retrievable from `sources.stores.blobs`. Only the greedy choice of segments, which depends on
what has been chosen before, folds a document in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.operators import similarity
from lodestream.session import small_batches


def line_digests(rows: DataFrame, group: str, order: str, line: str, chunk: int = 1 << 16) -> DataFrame:
    """group, md5: of each group's lines in order, with line ends between them; null lines are left out.

    Lines are sorted over all tasks and packed into chunks of about `chunk` characters, several groups' in a task. MD5
    can't be put together from parts: one task reads the chunks of a group, one after another.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = rows.where(F.col(line).isNotNull()).select(F.col(group).alias("group"), F.col(order).alias("order"), F.col(line).alias("line"))
    spread = slim.repartitionByRange(parts, "group", "order", "line").sortWithinPartitions("group", "order", "line")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, size, nth = None, [], 0, 0

        def out() -> pa.RecordBatch:
            values = (*head, nth, "\n".join(held).encode())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            types = [batch.schema.field(c).type for c in ("group", "order", "line")] + [pa.int64(), pa.binary()]
            for of, at, text in zip(*(batch.column(c).to_pylist() for c in ("group", "order", "line"))):
                if held and (size >= chunk or of != head[0]):
                    yield out()
                    held, size, nth = [], 0, nth + 1
                if not held:
                    head = (of, at, text)
                held.append(text)
                size += len(text) + 1
        if held:
            yield out()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], names=["group", "md5"])

        for batch in batches:
            kind = batch.schema.field("group").type
            for of, body in zip(batch.column("group").to_pylist(), batch.column("body")):
                if digest and of == now:
                    digest.update(b"\n")
                else:
                    if digest:
                        yield out()
                    now, digest = of, hashlib.md5()
                digest.update(body.as_buffer())
        if digest:
            yield out()

    names = ["group", "order", "line", "nth", "body"]
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    small_batches(rows.sparkSession)
    chunks = spread.mapInArrow(pack, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", nth long, body binary")
    # chunks that begin alike come from one task, which numbers them
    inorder = chunks.repartition("group").sortWithinPartitions("group", "order", "line", "nth").select("group", "body")
    return inorder.mapInArrow(fold, f"`group` {kinds['group']}, md5 string")


def lines_of(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, at, line; null texts have none."""
    return rows.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\r?\n")).alias("at", "line"))


def joined(rows: DataFrame, by: list[str], order: str, value: str, name: str, glue: str = "\n") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), glue).alias(name))


def chosen_log_lines(lines: DataFrame, errors: int = 10, warnings: int = 5, around: int = 3) -> DataFrame:
    """id, at, line, score: errors and different warnings by score, their surroundings, the first and last line.

    Score by level 1 (fatal, error), 0.5 (warn), 0.1 (info), 0.05 (debug), 0.02 (other), summaries 0.4 more, 1 at most.
    """
    level = T.log_level(F.col("line"))
    out = lines.withColumn("level", level)
    base = F.when(F.col("level").isin("FATAL", "ERROR"), 1.0).when(F.col("level") == "WARN", 0.5).when(F.col("level") == "INFO", 0.1).when(F.col("level").isin("DEBUG", "TRACE"), 0.05).otherwise(0.02)
    summary = F.lower("line").rlike(r"^=+ .* =+$|[0-9]+ (passed|failed|errors?|warnings?)")
    out = out.withColumn("score", F.least(F.lit(1.0), base + F.when(summary, 0.4).otherwise(0.0)))
    key = F.when(F.col("level") == "WARN", similarity.line_key(F.col("line"))).otherwise(F.col("at").cast("string"))
    out = out.withColumn("__nth", F.row_number().over(W.partitionBy("id", key).orderBy("at")))
    kind = F.when(F.col("level").isin("FATAL", "ERROR"), "e").when((F.col("level") == "WARN") & (F.col("__nth") == 1), "w")
    out = out.withColumn("__kind", kind)
    rank = F.row_number().over(W.partitionBy("id", "__kind").orderBy(F.desc("score"), "at"))
    most = F.when(F.col("__kind") == "e", errors).when(F.col("__kind") == "w", warnings).otherwise(0)
    size = F.max("at").over(W.partitionBy("id"))
    out = out.withColumn("__keep", (rank <= most) | summary)
    near = F.max(F.col("__keep").cast("int")).over(W.partitionBy("id").orderBy("at").rowsBetween(-around, around)) == 1
    out = out.withColumn("__near", near | (F.col("at") == 0) | (F.col("at") == size))
    return out.where("__near").select("id", "at", "line", "score")


def compressed_logs(rows: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """id, text, kept_lines, lines."""
    lines = lines_of(rows, id_col, text_col)
    kept = chosen_log_lines(lines, **options)
    sizes = lines.groupBy("id").agg(F.count(F.lit(1)).alias("lines"))
    return joined(kept, ["id"], "at", "line", "text").join(kept.groupBy("id").agg(F.count(F.lit(1)).alias("kept_lines")), "id").join(sizes, "id")


def search_hits(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, at, file, number, body of lines such as `file:12:body` or `file-12-body`, Windows drives included."""
    pattern = r"^((?:[A-Za-z]:)?[^:\n]+?)[:-]([0-9]+)[:-](.*)$"
    part = lambda g: F.regexp_extract("line", pattern, g)
    out = lines_of(rows, id_col, text_col).where(F.col("line").rlike(pattern))
    return out.select("id", "at", part(1).alias("file"), part(2).cast("long").alias("number"), part(3).alias("body"))


def chosen_hits(hits: DataFrame, context: str = "", files: int = 15, per_file: int = 5) -> DataFrame:
    """The hits of the files with the greatest scores: of each its first, its last and the best others.

    Score: 0.3 for each word of the context over two letters that a body holds, 0.5, 0.4 or 0.3 by importance; 1 at most.
    """
    score: Column = F.lit(0.0)
    for word in {w for w in context.lower().split() if len(w) > 2}:
        score = score + F.when(F.contains(F.lower("body"), F.lit(word)), 0.3).otherwise(0.0)
    kind = T.importance(F.col("body"))
    score = F.least(F.lit(1.0), score + F.when(kind == "error", 0.5).when(kind == "warning", 0.4).when(kind == "importance", 0.3).otherwise(0.0))
    by = W.partitionBy("id", "file")
    out = hits.withColumn("score", score).withColumn("__total", F.sum("score").over(by))
    out = out.withColumn("__file", F.dense_rank().over(W.partitionBy("id").orderBy(F.desc("__total"), "file"))).where(F.col("__file") <= files)
    edge = (F.col("at") == F.min("at").over(by)) | (F.col("at") == F.max("at").over(by))
    rank = F.row_number().over(by.orderBy(F.col("__edge").desc(), F.desc("score"), "at"))
    return out.withColumn("__edge", edge).withColumn("__rank", rank).where(F.col("__rank") <= per_file).select("id", "at", "file", "number", "body", "score")


def diff_lines(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, at, line, file, hunk (counted in its document), change (+, - or null) of unified diffs."""
    so_far = W.partitionBy("id").orderBy("at")
    out = lines_of(rows, id_col, text_col)
    named = F.when(F.col("line").rlike(r"^diff --git "), F.regexp_extract("line", r" b/(.*)$", 1)).when(F.col("line").rlike(r"^\+\+\+ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]*)", 1))
    out = out.withColumn("file", F.last(named, ignorenulls=True).over(so_far)).withColumn("hunk", F.sum(F.col("line").startswith("@@").cast("int")).over(so_far))
    change = F.when((F.col("hunk") > 0) & F.col("line").rlike(r"^[+-]") & ~F.col("line").rlike(r"^(\+\+\+|---) "), F.substring("line", 1, 1))
    return out.withColumn("change", change)


def chosen_hunks(lines: DataFrame, context: str = "", per_file: int = 10, files: int = 20, around: int = 2) -> DataFrame:
    """Lines of each file's first, last and best hunks; of these the heads, the changes and `around` lines by each.

    Score: 0.03 a change up to 0.3, 0.2 for each word of the context, 0.3 if a changed line looks like an error; 1 at most.
    """
    body = lines.where((F.col("hunk") > 0) & ~F.col("line").rlike(r"^(diff --git|index |--- |\+\+\+ )"))
    words: Column = F.lit(0.0)
    for word in {w for w in context.lower().split() if len(w) > 2}:
        words = words + F.when(F.max(F.contains(F.lower("line"), F.lit(word)).cast("int")) == 1, 0.2).otherwise(0.0)
    urgent = F.max((F.col("change").isNotNull() & (T.importance(F.col("line")) == "error")).cast("int")) == 1
    hunks = body.groupBy("id", "file", "hunk").agg(F.least(F.lit(1.0), F.least(F.lit(0.3), 0.03 * F.count("change")) + words + F.when(urgent, 0.3).otherwise(0.0)).alias("score"))
    by = W.partitionBy("id", "file")
    edge = (F.col("hunk") == F.min("hunk").over(by)) | (F.col("hunk") == F.max("hunk").over(by))
    hunks = hunks.withColumn("edge", edge).withColumn("rank", F.row_number().over(by.orderBy(F.col("edge").desc(), F.desc("score"), "hunk")))
    hunks = hunks.withColumn("nth", F.dense_rank().over(W.partitionBy("id").orderBy("file"))).where((F.col("rank") <= per_file) & (F.col("nth") <= files))
    kept = body.join(hunks.select("id", "file", "hunk", "score"), ["id", "file", "hunk"])
    near = F.max(F.col("change").isNotNull().cast("int")).over(W.partitionBy("id", "hunk").orderBy("at").rowsBetween(-around, around)) == 1
    kept = kept.withColumn("__near", near | F.col("line").startswith("@@") | F.col("line").startswith("\\"))
    return kept.where("__near").select("id", "at", "file", "hunk", "line", "score")


#: Fixed pattern of what lies between segments.
_CUTS = r"\n+|(?<=[.!?])[ \t]+"


def segments(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, at, segment: lines, cut after sentence ends."""
    parts = F.split(text_col, _CUTS)
    return rows.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("at", "segment")).where(F.trim("segment") != "")


def crushed_text(rows: DataFrame, id_col: str, text_col: str, ratio: float = 0.5, context: str = "", overlap: float = 0.85) -> DataFrame:
    """id, text, kept, of: the best segments in order, up to `ratio` of the bytes.

    Score: 1.0 * recency + 2.0 * keyword relevance to the context + 1.5 * share of salient words, a quarter of it for
    segments below 12 bytes. Segments whose word triples mostly stand in chosen ones already are skipped. A text is a
    row, so one pass over the rows does it: no segment is shuffled.
    """
    asked = {w for w in context.lower().split() if w}

    def scored(x: Column) -> Column:
        segment = x["segment"]
        words = F.split(F.trim(segment), r"\s+")
        salient = F.size(F.filter(words, lambda w: w.rlike(r"[0-9]|^[A-Z]{2,}$|[A-Za-z_]+\.[A-Za-z_]+") | F.lower(w).rlike("^(" + "|".join(T.ERROR_WORDS) + ")"))) / F.size(words)
        relevant: Column = F.lit(0.0)
        for word in asked:
            relevant = relevant + F.when(F.array_contains(T.terms(segment), word), 1.0 / len(asked)).otherwise(0.0)
        score = 1.0 * (x["at"] + 1) / F.size("segments") + 2.0 * relevant + 1.5 * salient
        return F.when(F.octet_length(segment) < 12, score / 4).otherwise(score)

    @F.arrow_udf("struct<text:string,kept:bigint,of:bigint>")
    def choose(segments: pa.Array, scores: pa.Array) -> pa.Array:
        return pa.array([_chosen(x.as_py(), s.as_py(), ratio, overlap) for x, s in zip(segments, scores)], kind)

    kind = pa.struct([("text", pa.string()), ("kept", pa.int64()), ("of", pa.int64())])
    small_batches(rows.sparkSession)
    numbered = F.transform(F.split(text_col, _CUTS), lambda x, k: F.struct(k.alias("at"), x.alias("segment")))
    parts = rows.select(F.col(id_col).alias("id"), F.filter(numbered, lambda x: F.trim(x["segment"]) != "").alias("segments")).where(F.size("segments") > 0)
    texts = F.transform("segments", lambda x: x["segment"])
    return parts.select("id", choose(texts, F.transform("segments", scored)).alias("chosen")).select("id", "chosen.*")


def _chosen(segments: list[str], scores: list[float], ratio: float, overlap: float) -> dict:
    """The greedy choice of one text's segments; the first of equal scores comes first."""
    sizes = [len(x.encode()) for x in segments]
    room, seen, kept = ratio * sum(sizes), set(), []
    for k in sorted(range(len(segments)), key=lambda k: -scores[k]):
        if sizes[k] > room:
            continue
        w = segments[k].lower().split()
        own = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        if len(own & seen) >= overlap * len(own):
            continue
        room -= sizes[k]
        seen |= own
        kept.append(k)
    return {"text": " ".join(segments[k] for k in sorted(kept)), "kept": len(kept), "of": len(segments)}


def page_text(html: Column) -> Column:
    """The visible text of a page: without scripts, styles, navigation, comments and tags; spaces collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside)[^>]*>.*?</(script|style|nav|header|footer|aside)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def array_items(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, at, item (JSON text) of JSON arrays; other texts have none."""
    items = F.from_json(json_col, "array<string>")
    return rows.select(F.col(id_col).alias("id"), F.posexplode(items).alias("at", "item"))


def marked_items(items: DataFrame, keep: int = 15, sigmas: float = 2.0, query: str = "") -> DataFrame:
    """items (id, at, item) with of and __keep: which ones stay of arrays of records cut to about `keep` items.

    Never cut: items that name an error, with a number over `sigmas` deviations from its field's mean, or with a word
    of the query. Then come the first 30 and last 15 percent of `keep` and the rest by position; equal items count once.
    """
    items = items.withColumn("__nth", F.row_number().over(W.partitionBy("id", F.md5(F.col("item").cast("binary"))).orderBy("at")))
    fields = items.select("id", "at", F.explode(F.from_json("item", "map<string,string>")).alias("field", "value")).withColumn("x", F.expr("try_cast(value AS double)")).where(F.col("x").isNotNull())
    by = W.partitionBy("id", "field")
    odd = fields.withColumn("__m", F.avg("x").over(by)).withColumn("__s", F.stddev_samp("x").over(by)).where(F.abs(F.col("x") - F.col("__m")) > sigmas * F.col("__s")).select("id", "at").distinct().withColumn("__odd", F.lit(True))
    items = items.join(odd, ["id", "at"], "left")
    hit: Column = F.lit(False)
    for word in query.lower().split():
        hit = hit | F.contains(F.lower("item"), F.lit(word))
    must = T.has_error_words(F.col("item")) | F.coalesce("__odd", F.lit(False)) | hit
    size = F.count(F.lit(1)).over(W.partitionBy("id"))
    first, last = max(1, round(keep * 0.3)), max(1, round(keep * 0.15))
    edge = (F.col("at") < first) | (F.col("at") >= F.col("of") - last)
    items = items.withColumn("of", size).withColumn("__must", must & (F.col("__nth") == 1))
    rank = F.row_number().over(W.partitionBy("id").orderBy((F.col("__nth") > 1).cast("int"), F.col("__must").desc(), edge.desc(), "at"))
    return items.withColumn("__keep", (F.col("of") <= keep) | F.col("__must") | ((rank <= keep) & (F.col("__nth") == 1)))


def crushed_items(items: DataFrame, keep: int = 15, sigmas: float = 2.0, query: str = "") -> DataFrame:
    """id, at, item of the items (id, at, item) that stay, with kept, of, dropped_key of their array.

    Arrays may be longer than a cell holds: dropped ones are told by an aggregated hash of their places and texts.
    """
    marked = marked_items(items, keep, sigmas, query)
    gone = F.when(~F.col("__keep"), F.xxhash64("at", "item"))
    key = F.when(F.count(gone) > 0, T.content_key(F.concat_ws(":", F.bit_xor(gone), F.count(gone)), 12))
    whole = marked.groupBy(F.col("id").alias("__id")).agg(F.count(F.when(F.col("__keep"), 1)).alias("kept"), F.count(F.lit(1)).alias("of"), key.alias("dropped_key"))
    stay = marked.where("__keep").select("id", "at", "item")
    return stay.join(whole, F.col("id").eqNullSafe(F.col("__id"))).drop("__id")


def crushed_arrays(rows: DataFrame, id_col: str, json_col: str, keep: int = 15, sigmas: float = 2.0, query: str = "") -> DataFrame:
    """id, items (JSON array text), kept, of, dropped_key: arrays in cells, crushed as by `marked_items`."""
    items = marked_items(array_items(rows, id_col, json_col), keep, sigmas, query)
    part = lambda keep_it: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep_it, F.struct("at", "item")))), lambda x: x["item"]), ",")
    out = items.groupBy("id").agg(F.concat(F.lit("["), part(F.col("__keep")), F.lit("]")).alias("items"), F.count(F.when(F.col("__keep"), 1)).alias("kept"), F.max("of").alias("of"), part(~F.col("__keep")).alias("__gone"))
    return out.select("id", "items", "kept", "of", F.when(F.col("kept") < F.col("of"), T.content_key(F.col("__gone"), 12)).alias("dropped_key"))
