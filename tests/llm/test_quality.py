import math
import random

import numpy as np
import pytest

from lodestream.llm import quality


@pytest.fixture(scope="module")
def labelled(spark):
    from lodestream.session import ship_package

    ship_package(spark)
    r = random.Random(6)
    good, bad = [f"g{k}" for k in range(50)], [f"b{k}" for k in range(50)]
    docs = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(40))) for i in range(300)]
    labels = [(i, i % 2, 0) for i in range(0, 100)] + [(5000, 1, 0), (None, 1, 0), (3, None, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_model_as_brute_force(labelled):
    docs, labels, rows = labelled
    model = quality.fit(docs.toDF("id", "text"), labels.toDF("id", "quality", "toxic"), buckets=64)
    raw, target = np.zeros(64), np.zeros(64)
    for i, t in rows:
        f = np.bincount(quality.features(t, 64), minlength=64)
        raw += f
        target += f * (i % 2 == 1 and i < 100)
    want = np.log((target + 1) / (target.sum() + 64)) - np.log((raw + 1) / (raw.sum() + 64))
    assert np.allclose(model, want)


def test_sample_takes_the_greatest_keys(labelled):
    docs, labels, rows = labelled
    got = quality.sampled(docs, labels, share=0.3, temper=200.0).toPandas()
    kept = got[got.kept]
    assert len(kept) == math.ceil(0.3 * len(rows)) and kept.sample_key.min() > got[~got.kept].sample_key.max()
    assert (kept.id % 2 == 1).mean() > 0.95
    assert got[got.id % 2 == 1].score.min() > got[got.id % 2 == 0].score.max()
    again = quality.sampled(docs.repartition(5), labels, share=0.3, temper=200.0).toPandas()
    assert set(again[again.kept].id) == set(kept.id)


def test_keys_as_brute_force(labelled, spark):
    """Gumbel top-k from its definition, on the noise of Spark's hash."""
    docs, labels, rows = labelled
    got = quality.sampled(docs, labels, share=0.4, temper=3.0, seed=5).toPandas().set_index("id")
    from pyspark.sql import functions as F

    bits = {r.i: r.b for r in spark.range(300).select(F.col("id").alias("i"), F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(5)), F.lit(2**52)).alias("b")).collect()}
    keys = {i: 3.0 * got.log_weight[i] / got.n_features[i] - math.log(-math.log((bits[i] + 0.5) / 2**52)) for i, _ in rows}
    want = set(sorted(keys, key=keys.get)[-120:])
    assert set(got.index[got.kept]) == want and all(math.isclose(got.sample_key[i], keys[i], rel_tol=1e-9) for i in keys)


def test_inclusion_follows_the_weights(spark):
    """Of many documents with two weights, sampled few: each is taken about in proportion to its weight."""
    rows = [(i, 1, float(i % 2)) for i in range(40_000)]
    found = spark.createDataFrame(rows, "id long, n_features long, log_weight double")
    from unittest import mock

    with mock.patch.object(quality, "weights", lambda docs, model: found), mock.patch.object(quality, "fit", lambda *a, **k: None):
        got = quality.sampled(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"), share=0.02, temper=1.5).where("kept").toPandas()
    odd = (got.id % 2 == 1).sum()
    assert odd / (len(got) - odd) == pytest.approx(math.exp(1.5), rel=0.25)


def test_fitted_temper_meets_the_effective_size(labelled, spark):
    r = random.Random(2)
    x = [r.gauss(0, 0.7) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in x], "mean_log_ratio double")
    size = lambda t: sum(math.exp(t * v) for v in x) ** 2 / sum(math.exp(2 * t * v) for v in x) / len(x)
    t = quality.fitted_temper(df, 0.5)
    assert size(t) >= 0.5 > size(t * 2 ** (1 / 6) * 1.0001)
    docs, labels, _ = labelled
    got = quality.sampled(docs, labels, share=0.5).toPandas()
    top = set(got.nlargest(150, "score").id)
    assert 0 < len(set(got[got.kept].id) - top) < 75  # noise moves some rows over the threshold, weights keep most


def test_held_out_labels_are_told_apart(spark, small):
    """The model is fitted on three quarters of the labels and ranks the documents of the last quarter."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{small}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = quality.sampled(docs, labels.where(~fold)).join(labels.where(fold & F.col("quality").isNotNull()).select(F.col("doc_id").alias("id"), "quality"), "id").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert len(good) > 20 and len(bad) > 5
    assert (good[:, None] > bad[None, :]).mean() > 0.9


def test_kth_greatest(spark):
    r = random.Random(1)
    x = [r.choice([r.gauss(0, 1e3), 5.0, -1e300, 1e-300]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in x], "k double")
    for k in (1, 2, 77, 499, 500, 900):
        assert quality.kth_greatest(df, "k", k) == sorted(x, reverse=True)[min(k, 500) - 1]
    assert quality.kth_greatest(df, "k", 0) is None and quality.kth_greatest(df.limit(0), "k", 3) is None


def test_odd_rows_and_empty_tables(odd, odd_rows, none, labelled):
    _, labels, _ = labelled
    got = quality.sampled(odd, labels, share=1.0)
    assert got.count() == len(odd_rows) and got.where("kept").count() == len(odd_rows)
    assert quality.sampled(odd, labels.limit(0)).where("log_weight = 0").count() == len(odd_rows)
    assert quality.sampled(none, labels).count() == 0
    out = quality.resampled(odd, labels, share=0.4)
    assert out.columns == odd.columns and 0 < out.count() < len(odd_rows)
