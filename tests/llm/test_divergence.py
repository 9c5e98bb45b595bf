import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestream.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, least_docs=30, most_ranks=50):
    """The audit's rows from (lang, source, text) by dictionaries."""
    count, docs = defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for lang, source, text in ((a or "", b or "", c) for a, b, c in rows):
        sources[lang].add(source)
        found = terms(text)
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        of = {s: shares(count[lang, s]) for s in own}
        q = shares(sum((count[lang, s] for s in own), Counter()))
        for s in own:
            pair = sorted((-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            term = sorted((q[t] - of[s][t], t.encode(), t) for t in kept if count[lang, s][t] and of[s][t] > q[t])[:most_ranks]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def test_boundaries_are_those_of_the_expression():
    r = random.Random(2)
    pool = ["a", "B", "z", "Z", "é", "漢", " ", "1", "[", "`", "{", "@", "\x7f", "\x00", "\U0001f600", "-"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(12))) for _ in range(500)] + ["", "", "x"]
    group, found, n, docs = divergence.count_run(pa.array(texts), np.arange(len(texts)))
    want = {(k, t): c for k, text in enumerate(texts) for t, c in Counter(terms(text)).items()}
    assert {(g, t.decode()): c for g, t, c in zip(group.tolist(), found, n.tolist())} == want
    assert set(docs.tolist()) == {1}


@pytest.mark.parametrize("digest", [lambda b: 0, len, lambda b: b[0] % 3])
def test_equal_hashes_of_other_bytes_are_told_apart(digest):
    r = random.Random(3)
    texts = [" ".join(r.choice("ab abc abd b ba c cc ccc".split()) for _ in range(30)) for _ in range(40)]
    of = np.array([k % 3 for k in range(40)])
    want = divergence.count_run(pa.array(texts), of)
    got = divergence.count_run(pa.array(texts), of, lambda b: digest(bytes(b)))

    def rows(x):
        return sorted(zip(x[0].tolist(), x[1], x[2].tolist(), x[3].tolist()))

    assert rows(got) == rows(want)


def test_verification_goes_piece_by_piece():
    folded = np.frombuffer(b"abcabdab", np.uint8)
    a, b = np.array([0, 0, 3, 0]), np.array([3, 3, 0, 6])
    assert divergence._unlike(folded, a, a + 2, b, b + 2, step=2).tolist() == []
    assert divergence._unlike(folded, a, a + np.array([3, 2, 2, 2]), b, b + np.array([3, 3, 2, 2]), step=3).tolist() == [0, 1]


def test_sparse_distances_equal_dense_ones():
    r = np.random.default_rng(4)
    for size, terms_ in ((1, 5), (4, 0), (5, 7), (9, 40)):
        unstored = r.integers(0, 50, size)
        dense = np.repeat(unstored[:, None], terms_, 1)
        stored = r.random((size, terms_)) < 0.4
        dense[stored] = r.integers(0, 90, int(stored.sum()))
        rows, columns = np.nonzero(stored)
        shuffled = r.permutation(len(rows))
        got = divergence.distances(rows[shuffled], columns[shuffled], dense[stored][shuffled] if len(rows) else np.zeros(0, int), unstored, terms_)
        assert (got == np.abs(dense[:, None, :] - dense[None, :, :]).sum(2)).all()


def test_runs_cut_batches_by_bytes(monkeypatch):
    monkeypatch.setattr(divergence, "RUN_BYTES", 10)
    texts = ["abc", "defg", "", "x" * 30, "hi", "jk", "lmnopqrst", "u"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    runs = [t.column("text").to_pylist() for t in divergence._runs(iter([batch, batch.slice(0, 0), batch]))]
    assert [t for run in runs for t in run] == texts * 2
    assert max(len(run) for run in runs) > 1 and all(len(run) == 1 or sum(map(len, run)) <= 10 for run in runs)


def test_audit_equals_dictionaries(spark, monkeypatch):
    r = random.Random(5)
    words = ["Apple", "pear", "apple", "plum", "naïve", "NAÏVE", "漢字", "fig", "x1y", "rare"]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "S3", None, "é"]), " ".join(r.choice(words[: 3 + k % 8]) for _ in range(r.randrange(9)))) for k in range(400)]
    rows += [("en", "empty", None), ("fr", "a", "few words"), ("fr", "b", None), ("it", "alone", "one")] + [("en", "s1", "plum plum")] * 9
    df = spark.createDataFrame([(*row, "x") for row in rows], "lang string, source string, text string, term string").repartition(5)
    for cells in (divergence.BLOCK_CELLS, 6):
        monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
        for least, ranks in ((30, 50), (3, 2)):
            got = sorted(tuple(x) for x in divergence.audit(df, least_docs=least, most_ranks=ranks).select("lang", "source", "part", "item", "value", "rank").collect())
            assert got == brute(rows, least, ranks)


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0, 1), (10**12, 3 * 10**12 + 1, 7), (9 * 10**15, 9 * 10**15, 10**6), (1, 10**17, 10**9)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    got = [x[0] for x in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 1_000_000_000 * (c + 5) // (n + 5 * v) for c, n, v in rows]


def test_odd_rows(spark, odd, odd_rows, none):
    got = sorted(tuple(x) for x in divergence.audit(odd, least_docs=2).collect())
    assert got == brute([(lang, source, text) for _, text, lang, source, *_ in odd_rows], 2)
    assert divergence.audit(none).count() == 0
