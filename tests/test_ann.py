import numpy as np
import pytest

from lodestream.operators import ann


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16))
    rows = [(i, (middles[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, rows[7][1]), (5003, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def exact(rows, ids, k):
    known = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == 16]
    out = {}
    for q, x in known:
        if q in ids:
            size = np.linalg.norm(x)
            sims = sorted((-round(float(x @ v / (size * np.linalg.norm(v))) if size and np.linalg.norm(v) else 0.0, 6), i) for i, v in known if i != q)
            out[q] = [(i, -s) for s, i in sims[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query"], []).append((r.id, r.similarity))
    return out


def test_all_lists_give_the_exact_result(vectors, tmp_path, monkeypatch):
    rows, df = vectors
    monkeypatch.setattr(ann, "PART", 40)  # lists of several parts
    index = ann.VectorIndex.build(df, "vec_id", "embedding", str(tmp_path / "v"), centres=10)
    got = found(index.nearest(df.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, probes=10))
    want = exact(rows, {i for i, _ in rows if i % 50 == 0}, 10)
    for q, near in want.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in near], abs=2e-6), q
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in want.items()) >= 0.99 * 10 * len(want)


def test_recall_in_a_later_session_and_after_more_is_added(spark, vectors, tmp_path):
    rows, df = vectors
    path = str(tmp_path / "v")
    ann.VectorIndex.build(df.where("vec_id < 1000"), "vec_id", "embedding", path)
    index = ann.VectorIndex(spark, path)  # as a later session finds it
    index.add(df.where("vec_id >= 1000 and embedding is not null"), "vec_id", "embedding")
    got = found(index.nearest(df.where("vec_id % 50 = 0"), "vec_id", "embedding", 10))
    want = exact(rows, {i for i, _ in rows if i % 50 == 0 and i < 1500}, 10)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in near}) / 10 for q, near in want.items()]) >= 0.9
    assert all(q not in dict(near) for q, near in got.items())


def test_recall_of_the_query_over_all_its_queries(spark, small):
    """Against the exact search over the whole table, for every query that it states."""
    import __spark_entry__ as entry

    got, want = (found(entry.queries()[name](spark, small)) for name in ("approximate_top_k", "vector_top_k"))
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = ann.VectorIndex.build(none, "vec_id", "embedding")
    assert index.nearest(none, "vec_id", "embedding", 3).count() == 0
