"""Longest common subsequences against the plain table, deflated sizes against the library."""

import zlib

from hypothesis import given
from hypothesis import strategies as st

from lodestream.operators import sequences


def by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(st.lists(st.sampled_from("abcd")), st.lists(st.sampled_from("abcd")))
def test_common_subsequence(a, b):
    assert sequences.common_subsequence(a, b) == by_table(a, b)


def test_rouge_l(spark):
    rows = [(1, "a b c d", "a c d e"), (2, None, "a"), (3, "", ""), (4, "A b", "a B"), (4, "x", "y")]
    df = spark.createDataFrame(rows, "k int, c string, r string")
    got = sorted(tuple(x) for x in sequences.rouge_l(df, ["k"], "c", "r").collect())
    assert got == [(1, 0.75), (2, 0.0), (3, 0.0), (4, 0.0), (4, 1.0)]
    assert not sequences.rouge_l(df.limit(0), ["k"], "c", "r").collect()


def test_deflated(spark):
    texts = ["", None, "aé" * 5000, "word"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: (r["size"], r["packed"]) for r in sequences.deflated(df, "k", "t").collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        assert got[k] == (len(data), len(zlib.compress(data, 1)))
