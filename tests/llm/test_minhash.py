import numpy as np

from lodestream.llm import minhash
from lodestream.llm.graph import components


def brute(rows):
    sets, ids = [], []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets.append(s)
        ids.append(i)
    parent = {i: i for i in ids if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in zip(ids, sets)), key=str)


def test_groups_as_brute_force(odd, odd_rows):
    assert sorted(map(tuple, minhash.groups(odd).collect()), key=str) == brute(odd_rows)


def test_a_group_with_chains_and_misses(spark):
    import random

    r = random.Random(3)
    base = [f"w{r.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])):
            t[r.randrange(120)] = f"v{r.randrange(30)}"
        rows.append((i, " ".join(t[: r.choice([120, 115, 95])])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, minhash.groups(df).collect()), key=str) == brute(rows)


def test_blocks_and_small_hubs_do_not_change_the_groups(spark, monkeypatch):
    import random

    r = random.Random(4)
    base = [f"w{r.randrange(10_000)}" for _ in range(100)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(r.choice([3, 4, 5, 6, 7, 8])):
            t[r.randrange(100)] = f"v{r.randrange(2000)}"
        rows.append((i, " ".join(t[: r.choice([100, 96, 88, 80])])))
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    monkeypatch.setattr(minhash, "SALT_ROWS", 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, minhash.groups(df).collect()), key=str) == brute(rows)


def test_min_and_max_estimate_similarity():
    a = minhash.shingle_set(" ".join(f"w{i}" for i in range(1000)), 5)
    b = minhash.shingle_set(" ".join(f"w{i}" for i in range(200, 1200)), 5)
    same = np.mean(minhash.signature(a, 512) == minhash.signature(b, 512))
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.05


def test_drop_keeps_one_of_each_group(odd, odd_rows):
    out = minhash.drop_near_duplicates(odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((i for i, _, _, kept in brute(odd_rows) if kept), key=str)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (10, 11), (11, 10), *((100, i) for i in range(101, 160))]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 10: 10, 11: 10, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(none):
    assert minhash.groups(none).count() == 0
