"""Queries over whole texts: one pass over the rows in small batches, and nothing as long as a text is shuffled."""

import pytest

from lodestream.operators import compressors, diffs, logs, profile, similarity

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


@pytest.mark.parametrize("run", [logs.compressed, diffs.detected, diffs.compressed])
def test_batches_of_texts_are_small(spark, run):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "10000")
    try:
        out = run(docs(spark, "a", None, "b\n" * 60), "id", "text")
        assert int(spark.conf.get(BATCH)) <= 1000
        assert out.count() == (3 if run is diffs.detected else 2)
    finally:
        spark.conf.set(BATCH, before)


def test_entropy_shuffles_counts_once_and_adds_up_texts_of_one_id(spark):
    rows = spark.createDataFrame([(1, "aab"), (1, "b"), (2, "\U0001f600é"), (3, "zzz"), (4, ""), (5, None)], "id long, text string")
    out = similarity.char_entropy(rows, "id", "text")
    assert plan(out).count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in out.collect()} == {(1, 1.0), (2, 1.0), (3, 0.0)}


def test_importance_is_counted_without_a_row_for_each_line(spark):
    rows = docs(spark, "an ERROR: note\r\nfix\x85me it\n_error\n", None, "", "WARNING \nwarn\n(failed)\nérrors")
    out = profile.importance_counts(rows, "text")
    assert "Generate" not in plan(out)
    assert {r.kind: r.n for r in out.collect()} == {"error": 2, "importance": 1, "warning": 2, "none": 4}


def test_crushed_text_shuffles_no_segments(spark):
    rows = docs(spark, "One two three. Four FIVE 6 seven.\nOne two three.", "", None, " \n ", "x")
    out = compressors.crushed_text(rows, "id", "text", ratio=0.7)
    assert "Exchange" not in plan(out)
    got = {r.id: (r.text, r.kept, r["of"]) for r in out.collect()}
    assert got[0] == ("Four FIVE 6 seven. One two three.", 2, 3) and got[4] == ("", 0, 1) and set(got) == {0, 4}


def test_only_large_arrays_meet_by_blocks_of_bits(spark, monkeypatch):
    from lodestream.operators import adaptive

    base = [(7919 * k * k) % (1 << 40) << 20 for k in range(150)]
    big = [h ^ flip for h in base for flip in (0, 0b101)]
    arrays = {"big": big, "small": [-1, -2, -8, -(1 << 63), 5, 7], "one": [3]}
    rows = [(a, k, h) for a, hashes in arrays.items() for k, h in enumerate(hashes)]
    taken, whole = [], adaptive.close_hashes
    monkeypatch.setattr(adaptive, "close_hashes", lambda nodes, *rest: taken.append(nodes) or whole(nodes, *rest))
    got = [tuple(r) for r in adaptive.close_pairs(spark.createDataFrame(rows, "array string, at long, hash long")).collect()]
    near = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count() <= 3
    want = {(a, i, j) for a, hs in arrays.items() for i in range(len(hs)) for j in range(i + 1, len(hs)) if near(hs[i], hs[j])}
    assert set(got) == want and len(got) == len(want)
    assert {r.array for r in taken[0].select("array").distinct().collect()} == {"big"}
