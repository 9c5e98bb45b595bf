"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample.

* Features: words (A-Z in lower case) and pairs of neighbouring words, hashed to `buckets` places.
* Two generative models: the share of each place among the features of the target (labelled documents of quality 1)
  and among those of all documents, both smoothed. A document's log weight is the log ratio of its likelihoods; per
  feature (`mean_log_ratio`) it doesn't depend on the document's length.
* Sampling without replacement in proportion to exp(temper * mean log ratio): the documents with the greatest keys,
  key = temper * mean log ratio + Gumbel noise, stay. Noise comes from a hash of id and seed, so that reruns agree.
* temper says how hard the weights pull. Unless given it is fitted: the greatest of a fixed ladder of values at which
  the weights' effective sample size, (sum w)^2 / sum w^2, is still `effective` of all documents. A greater value
  would make the sample a plain top-k, in which noise decides nothing.
* The k-th greatest key is found exactly by counting keys in ever narrower ranges; no keys meet in one place.

`target_rows` bounds the labelled rows that are looked up (those least by hash); everything else covers all documents.

Defined results
* null or empty texts have no features and log weight 0. Labels with null fields and labels of absent documents don't count.
* without any target the models are equal and the sample is uniform.
* rows that repeat an id have the same noise; rows with the key at the threshold all stay. Null ids share one noise.
* an empty table gives an empty result. Other columns are carried by `resampled` and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.minhash import mixed, word_hashes
from lodestream.session import written


def features(text: str | None, buckets: int) -> np.ndarray:
    """The places of a text's words and word pairs."""
    w = word_hashes(text or "")
    pairs = mixed(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])
    return (np.concatenate([w, pairs]) % np.uint64(buckets)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 16_384, target_rows: int = 20_000, smoothing: float = 1.0) -> np.ndarray:
    """log(target share / raw share) of each place, from rows (id, text) and (id, quality).

    Each task hands on its two count arrays once; Spark sums them by place.
    """
    good = labels.where((F.col("quality") == 1) & F.col("id").isNotNull()).select("id").distinct()
    good = good.orderBy(F.xxhash64("id"), "id").limit(target_rows).withColumn("good", F.lit(True))
    marked = docs.join(F.broadcast(good), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            found = [(features(t.as_py(), buckets), g) for t, g in zip(batch.column("text"), batch.column("good").to_pylist())]
            if found:
                raw += np.bincount(np.concatenate([f for f, _ in found]), minlength=buckets)
                target += np.bincount(np.concatenate([np.zeros(0, np.int64), *(f for f, g in found if g)]), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], names=["place", "raw", "target"])

    sums = marked.mapInArrow(count, "place long, raw long, target long").groupBy("place").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[sums["place"]], target[sums["place"]] = sums["raw"], sums["target"]
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + smoothing) / (target.sum() + smoothing * buckets)) - np.log((raw + smoothing) / (raw.sum() + smoothing * buckets))


def weights(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """id, n_features, log_weight of rows (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            found = [features(t.as_py(), len(table)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, found), pa.int64()), pa.array([float(table[f].sum()) for f in found], pa.float64())], names=["id", "n_features", "log_weight"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_features long, log_weight double")


def kth_greatest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th greatest value of a column of finite doubles, exactly; None if there are fewer than one.

    The range that holds it is cut into 4096 parts until it is a single value; the driver gets one count a part.
    """
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while low < high:
        width = (high - low) / 4096
        inside = keys.where(F.col(column).between(low, high))
        part = F.least(F.floor((F.col(column) - low) / width), F.lit(4095)).alias("part") if width > 0 else F.lit(0).alias("part")
        parts = inside.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for p in sorted(parts, key=lambda p: -p["part"]):
            if k <= p["n"]:
                low, high = p["low"], p["high"]
                break
            k -= p["n"]
        if k == 1:
            return high
    return low


#: Values of temper that are tried: sixth roots of two apart.
TEMPERS = [2.0 ** (k / 6) for k in range(-36, 61)]


def fitted_temper(found: DataFrame, effective: float) -> float:
    """The greatest of TEMPERS at which the effective sample size is at least `effective` of all rows (0 if none is).

    One pass: for each value, sums of w and w^2 relative to the greatest weight.
    """
    top = found.agg(F.max("mean_log_ratio")).first()[0]
    if top is None:
        return 0.0
    x = F.col("mean_log_ratio") - F.lit(top)
    sums = [f(F.exp(k * t * x)).alias(f"s{k}_{i}") for i, t in enumerate(TEMPERS) for k, f in ((1, F.sum), (2, F.sum))]
    row = found.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    fit = [t for i, t in enumerate(TEMPERS) if row[f"s1_{i}"] ** 2 / row[f"s2_{i}"] >= effective * row.n]
    return max(fit, default=0.0)


def sampled(docs: DataFrame, labels: DataFrame, share: float = 0.8, temper: float | None = None, effective: float = 0.5, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", quality_col: str = "quality", **options) -> DataFrame:
    """id, n_features, log_weight, score, sample_key, kept of every row; kept are ceil(share * rows) of the greatest keys.

    score is the importance weight per feature as a probability: the mean log ratio through the logistic function.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = labels.select(F.col(label_id_col).alias("id"), F.col(quality_col).alias("quality"))
    found = weights(slim, fit(slim, own, **options))
    mean = F.col("log_weight") / F.greatest(F.col("n_features"), F.lit(1))
    found = written(found.withColumn("mean_log_ratio", mean).withColumn("score", 1 / (1 + F.exp(-mean))), "weights")
    temper = fitted_temper(found, effective) if temper is None else temper
    noise = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(seed)), F.lit(2**52)).cast("double")
    uniform = (noise + 0.5) / 2.0**52
    found = found.withColumn("sample_key", F.lit(float(temper)) * F.col("mean_log_ratio") - F.log(-F.log(uniform)))
    n = found.count()
    least = kth_greatest(found, "sample_key", -int(-n * share // 1))
    kept = F.lit(False) if least is None else F.col("sample_key") >= F.lit(least)
    return found.select("id", "n_features", "log_weight", "score", "sample_key", kept.alias("kept"))


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` without the rows that the sample leaves out."""
    gone = sampled(docs, labels, id_col=id_col, **options).where(~F.col("kept")).select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), docs[id_col].eqNullSafe(F.col("__gone")), "left_anti")
