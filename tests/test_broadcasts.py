"""Queries whose joins grow on both sides: none may be turned into a broadcast, which the driver would have to hold."""

import pytest

import __spark_entry__ as entry

NAMES = ["bleu", "line_clusters", "adaptive_k", "deflated_k", "string_samples", "number_samples", "merged_memories"]


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("name", NAMES)
def test_joins_need_no_broadcast(spark, small, no_broadcasts, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_simhash_shuffles_sums_of_votes_and_no_grams(spark):
    """Ids that repeat are one text's grams and the other's; slices of a long text add up."""
    from collections import Counter

    from lodestream.operators import adaptive, similarity

    long = "".join(f"line {k * k % 9973}\n" for k in range(30_000))
    rows = [(1, "abc"), (2, "Aé漢\U0001f600bcd"), (2, "hello world"), (3, long), (4, ""), (5, None)]
    out = similarity.simhash(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    grams: dict[int, Counter] = {}
    for i, text in rows:
        if text:
            low = text.lower()
            grams.setdefault(i, Counter()).update(low[k : k + 4] for k in range(max(1, len(low) - 3)))
    want = set()
    for i, found in grams.items():
        sums = [sum(n if adaptive._gram_hash(g) >> k & 1 else -n for g, n in found.items()) for k in range(64)]
        whole = sum(1 << k for k in range(64) if sums[k] > 0)
        want.add((i, whole >> 32, whole & 0xFFFFFFFF))
    assert {tuple(r) for r in out.collect()} == want
