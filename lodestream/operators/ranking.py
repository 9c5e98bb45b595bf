"""Keyword, vector and hybrid ranking. Query sets are small and stated; documents are never paired with each other."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions import text as T

#: Terms, of 64 bytes or so each, up to which a query set's are broadcast.
BROADCAST_TERMS = 200_000
#: Vectors in a block, queries multiplied with one at once, and how far below the k-th an inexact product is judged exactly.
PART, AT_ONCE, NEAR = 4_096, 256, 3e-6
K1, B, LN2 = 1.5, 0.75, 0.6931471805599453


def term_counts(docs: DataFrame, id_col: str, text_col: str, among: DataFrame | None = None) -> DataFrame:
    """id, term, tf, and the document's number of terms; only of the terms in `among`, where it is given.

    `among` meets the terms before they are counted, so that nothing else is shuffled; it is broadcast if it is small.
    """
    terms = docs.select(F.col(id_col).alias("id"), T.terms(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    terms = terms.select("id", F.size("terms").alias("length"), "terms")  # below the explode, which then carries no array
    terms = terms.select("id", "length", F.explode("terms").alias("term"))
    if among is not None:
        few = among.count() <= BROADCAST_TERMS
        terms = terms.join(F.broadcast(among) if few else among, "term", "left_semi")
    return terms.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def keyword_scores(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, corpus_idf: bool = False) -> DataFrame:
    """query, id, raw, matched, score. raw is BM25 with a constant idf of ln 2, or with the corpus's own.

    score is min(raw / 10, 1), raised by 0.3 (to 1 at most) where a matched term has 8 bytes or more. The join on terms
    shuffles matching postings only.
    """
    asked = term_counts(queries, query_id, query_text).select(F.col("id").alias("query"), "term", F.col("tf").alias("qf"))
    found = term_counts(docs, id_col, text_col, asked.select("term").distinct())
    size = docs.agg(F.avg(F.size(T.terms(F.coalesce(F.col(text_col), F.lit(""))))).alias("mean"), F.count(F.lit(1)).alias("docs"))
    joined = found.join(asked, "term").join(F.broadcast(size))
    idf: Column = F.lit(LN2)
    if corpus_idf:
        df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        joined = joined.join(df, "term")
        idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean"))) * F.col("qf")
    out = joined.groupBy("query", "id").agg(F.sum(part).alias("raw"), F.count(F.lit(1)).alias("matched"), F.max(F.octet_length("term")).alias("longest"))
    score = F.least(F.least(F.col("raw") / 10, F.lit(1.0)) + F.when(F.col("longest") >= 8, 0.3).otherwise(0.0), F.lit(1.0))
    return out.select("query", "id", F.round("raw", 4).alias("raw"), "matched", F.round(score, 4).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, least: float = -1.0, block: int = PART) -> DataFrame:
    """query, id, similarity, rank: the k most similar vectors of each query that reach `least`, by exact cosine.

    Queries and vectors are dealt into blocks; each block of queries meets each one of vectors in a task, which
    multiplies them as matrices, judges by `cosine`'s own arithmetic what comes near to the best, and keeps k rows a query.
    """
    held = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    blocks, parts = (max(1, -(-df.count() // block)) for df in (asked, held))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = held.select("*", dealt(parts).alias("part"), each(blocks).alias("block"))
    asked = asked.select("*", dealt(blocks).alias("block"), each(parts).alias("part"))
    kind = held.schema["id"].dataType.simpleString()
    found = held.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(lambda v, q: best_pairs(v, q, k, least), f"query {kind}, id {kind}, similarity double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def best_pairs(held: pa.Table, asked: pa.Table, k: int, least: float) -> pa.Table:
    """query, id, similarity: of the vectors (id, vector) the k most similar to each of those asked for; ties by id."""
    held = held.sort_by("id")
    ids, names = held.column("id").to_pylist(), asked.column("id").to_pylist()
    rows, wanted = _by_width(held.column("vector")), _by_width(asked.column("vector"))
    own: dict = {}
    for j, name in enumerate(ids):
        own.setdefault(name, []).append(j)
    out: list[tuple] = []
    for at in range(0, len(names) if ids else 0, AT_ONCE):
        here = names[at : at + AT_ONCE]
        near, odd = np.zeros((len(here), len(ids))), np.zeros((len(here), len(ids)), bool)
        for width, q in wanted.items():
            mine = (q["at"] >= at) & (q["at"] < at + AT_ONCE)
            if width in rows and mine.any():
                v, place = rows[width], np.ix_(q["at"][mine] - at, rows[width]["at"])
                near[place] = np.where(q["null"][mine][:, None] | v["null"], -np.inf, q["unit"][mine] @ v["unit"].T)
                odd[place] = (q["odd"][mine][:, None] | v["odd"]) & (near[place] > -np.inf)
        for j, name in enumerate(here):
            near[j, own.get(name, [])], odd[j, own.get(name, [])] = -np.inf, False
        judged = np.where(odd, -np.inf, near)
        last = np.partition(judged, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(here), -np.inf)
        i, j = np.nonzero((odd | (judged >= np.maximum(last, least)[:, None] - NEAR)) & (near > -np.inf))
        score = rounded(_exact(wanted, rows, i + at, j))
        high = np.where(np.isnan(score), np.inf, score)  # no number comes before all numbers, as in a descending order
        keep = np.flatnonzero(high >= least)
        keep = keep[np.lexsort((j[keep], -high[keep], i[keep]))]
        begins = np.searchsorted(i[keep], np.arange(len(here)))
        keep = keep[np.arange(len(keep)) - begins[i[keep]] < k]
        out += [(here[a], ids[b], c) for a, b, c in zip(i[keep].tolist(), j[keep].tolist(), score[keep].tolist())]
    kinds = (asked.schema.field("id").type, held.schema.field("id").type, pa.float64())
    return pa.table({name: pa.array([r[c] for r in out], kind) for c, (name, kind) in enumerate(zip(("query", "id", "similarity"), kinds))})


def _by_width(column: pa.ChunkedArray) -> dict[int, dict[str, np.ndarray]]:
    """Vectors as matrices by their width: which rows they are, values, lengths, values over length; those that hold nulls or are odd.

    Odd are those whose length is no number or too small to divide by: what they are multiplied to is judged exactly.
    """
    column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    widths, out = column.value_lengths().to_numpy(zero_copy_only=False), {}
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        flat = column.take(pa.array(at)).flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(at), width)
        null = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), width).any(axis=1)
        with np.errstate(all="ignore"):
            length = np.sqrt(_dots(values, values))
            odd = ~np.isfinite(length) | ((length > 0) & (length < 1e-140))
            unit = np.where((odd | (length == 0))[:, None], 0.0, values / length[:, None])
        out[width] = {"at": at, "values": values, "length": length, "unit": unit, "null": null, "odd": odd}
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first value to the last."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def _exact(wanted: dict, rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`cosine` of queries i and vectors j."""
    out = np.zeros(len(i))
    for width in set(wanted) & set(rows):
        q, v = wanted[width], rows[width]
        both = np.flatnonzero(np.isin(i, q["at"]) & np.isin(j, v["at"]))
        x, y = np.searchsorted(q["at"], i[both]), np.searchsorted(v["at"], j[both])
        with np.errstate(all="ignore"):
            size = q["length"][x] * v["length"][y]
            out[both] = np.where(size == 0, 0.0, _dots(q["values"][x], v["values"][y]) / size)
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, halves away from 0 as Spark does: by decimals where a number is close to a half."""
    with np.errstate(all="ignore"):
        scaled = np.abs(x) * 1e6
        part = scaled - np.floor(scaled)
        out = np.sign(x) * (np.floor(scaled) + (part >= 0.5)) / 1e6
    for j in np.flatnonzero(np.abs(part - 0.5) < 1e-6):
        out[j] = float(Decimal(repr(float(x[j]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out + 0.0


def recency(age_days: Column, half: float = 30.0) -> Column:
    return F.when(age_days.isNull() | (age_days < 0), 1.0).otherwise(F.exp(-age_days / half))


def decayed_importance(importance: Column, age_days: Column, uses: Column, rate: float = 0.05) -> Column:
    """Importance that fades with age and rises with use."""
    return F.least(F.lit(1.0), importance * F.exp(-rate * age_days) + F.least(F.lit(0.3), 0.05 * uses))
