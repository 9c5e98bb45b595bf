import random
import zlib

import pytest

from lodestream.operators import adaptive


def clusters_in_order(hashes, most=3):
    reps, of = [], []
    for p, h in enumerate(hashes):
        near = [r for r in reps if bin(hashes[r] ^ h).count("1") <= most]
        if not near:
            reps.append(p)
        of.append(near[0] if near else p)
    return of


def brute_k(items, bias=1.0, min_k=3, max_k=None, deflate=True):
    n = len(items)
    cap = n if max_k is None else max_k
    if n <= 8:
        return n
    unique = len(set(clusters_in_order([adaptive.hash_of(t.lower()) for t in items])))
    if unique <= 3:
        return min(max(min_k, unique), cap)
    seen, curve = set(), []
    for t in items:
        words = t.lower().split()
        seen |= set(zip(words, words[1:])) if len(words) > 1 else {((words or [""])[0], "")}
        curve.append(len(seen))
    knee = None
    if curve[0] == curve[-1]:
        knee = 1
    else:
        gains = [(y - curve[0]) / (curve[-1] - curve[0]) - i / (n - 1) for i, y in enumerate(curve)]
        if max(gains) >= 0.05:
            knee = gains.index(max(gains)) + 1
    floor = max(min_k, int(n * (0.3 + 0.7 * (unique / n))))
    if knee is None:
        knee = floor
    elif unique / n > 0.7:
        knee = max(knee, floor)
    k = min(max(min_k, int(knee * bias)), cap)
    if deflate and k < n and k < cap:
        whole, part = "\n".join(items).encode(), "\n".join(items[:k]).encode()
        if len(whole) >= 200 and abs(len(zlib.compress(whole, 1)) / len(whole) - (len(zlib.compress(part, 1)) / len(part) if part else 1.0)) > 0.15:
            k = min(int(k * 1.2), cap)
    return max(min_k, min(k, cap))


@pytest.fixture(scope="module")
def arrays_():
    r = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    out = {
        "short": ["a"] * 8, "alike": ["abc"] * 10, "empty": [""] * 12, "unique": [f"unique item number {k} with some long content" for k in range(20)],
        "items": [f"item {k}" for k in range(20)], "fox": ["the quick brown fox jumps over the lazy dog"] * 20 + ["x y", "z", "1 2"],
        "late": ["same line here"] * 30 + [f"{r.random()} {r.random()}" for _ in range(30)], "early": [f"{r.random()} {r.random()}" for _ in range(20)] + ["same line here"] * 60,
        "one": ["x"], "tabs": [f"\t{w}\n{v} " for w in words for v in words], "é": [f"École {w}" for w in words] * 3,
    }
    for k in range(12):
        out[f"r{k}"] = [" ".join(r.choice(words) for _ in range(r.randrange(6))) for _ in range(r.randrange(9, 70))]
    return out


@pytest.fixture(scope="module")
def items(spark, arrays_):
    from lodestream.session import ship_package

    ship_package(spark)
    rows = [(a, p, t) for a, texts in arrays_.items() for p, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "array string, pos long, item string").repartition(3)


def test_hashes_of_known_texts():
    known = {"": 0xD41D8CD98F00B204, "a": 0x0CC175B9C0F1B6A8, "abcd": 0xE2FC714C4727EE93, "hello world": 0x4681260120120222, "café": 0x07117FE4A1EBD544}
    assert {t: adaptive.hash_of(t) for t in known} == known


def test_clusters_equal_a_pass_in_order(spark, items, arrays_):
    got = {(r.array, r.pos): r.representative for r in adaptive.clusters(items).collect()}
    for a, texts in arrays_.items():
        assert [got[a, p] for p in range(len(texts))] == clusters_in_order([adaptive.hash_of(t.lower()) for t in texts]), a


@pytest.mark.parametrize("seed", range(3))
def test_representatives_of_chains_and_stars(spark, seed):
    """Links that chain: covered nodes cover nothing, and what only they were linked to stands for itself."""
    r = random.Random(seed)
    links = {("chain", k, k + 1) for k in range(7)} | {("star", 0, k) for k in range(1, 6)} | {("back", k, 9) for k in range(5)}
    links |= {("mix", *sorted(r.sample(range(30), 2))) for _ in range(40)}
    want = {}
    for array in {x[0] for x in links}:
        nodes = sorted({n for a, *ends in links if a == array for n in ends})
        reps: list[int] = []
        for n in nodes:
            near = [m for m in reps if (array, m, n) in links]
            want[array, n] = near[0] if near else n
            reps += [] if near else [n]
    got = adaptive.first_representatives(spark.createDataFrame(sorted(links), "array string, a long, b long"))
    assert {(x.array, x.at): x.representative for x in got.collect()} == want


def test_close_pairs_miss_none(spark):
    r = random.Random(5)
    hashes = [r.getrandbits(64) for _ in range(12)]
    for h in list(hashes):
        for bits in range(1, 6):
            hashes.append(h ^ sum(1 << b for b in r.sample(range(64), bits)))
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    got = adaptive.close_pairs(spark.createDataFrame([("x", k, h) for k, h in enumerate(signed)], "array string, at long, hash long"))
    want = {(a, b) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if bin(hashes[a] ^ hashes[b]).count("1") <= 3}
    assert {(x.a, x.b) for x in got.collect()} == want


def test_running_totals_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(adaptive, "CHUNK", 7)
    rows = [(a, p, (p * 3 + len(a)) % 5) for a in ("x", "yy") for p in range(40)]
    got = {(r.array, r.pos): r.total for r in adaptive.running_total(spark.createDataFrame(rows, "array string, pos long, v long"), "v").collect()}
    assert got == {(a, p): sum(v for b, q, v in rows if b == a and q <= p) for a, p, _ in rows}


@pytest.mark.parametrize("settings", [{}, {"bias": 1.5, "max_k": 15}, {"bias": 0.6, "min_k": 2}, {"deflate": False}])
def test_k_equals_the_sequential_rule(items, arrays_, settings):
    got = {r.array: r.k for r in adaptive.optimal_k(items, **settings).collect()}
    assert got == {a: brute_k(t, **settings) for a, t in arrays_.items()}


def test_no_arrays(spark):
    none = spark.createDataFrame([], "array string, pos long, item string")
    assert adaptive.optimal_k(none).count() == 0


def brute_sample(texts, must, extra, k, distinct):
    n = len(texts)
    if n <= 8:
        return ["whole"] * n
    first = min(max(1, round(k * 0.3)), k)
    last = min(max(1, round(k * 0.15)), k - first)
    why = ["marked" if m else "edge" if p < first or p >= n - last else "dropped" for p, m in enumerate(must)]
    kept = {p for p in range(n) if why[p] != "dropped"}
    seen, room = {texts[p] for p in kept}, max(k - len(kept), 0)
    if room:
        for p in range(0, n, max((n - 1) // (room + 1), 1)):
            if len(kept) >= k + sum(extra):
                break
            if p not in kept and not (distinct and texts[p] in seen):
                kept.add(p)
                seen.add(texts[p])
                why[p] = "stride"
    return why


@pytest.mark.parametrize("distinct", [True, False])
def test_samples_equal_the_sequential_rule(spark, arrays_, distinct):
    rows, want, budgets = [], {}, []
    r = random.Random(3)
    for a, texts in arrays_.items():
        must = [r.random() < 0.08 for _ in texts]
        extra = [int(m) + int(r.random() < 0.05) for m in must]
        k = min(len(texts), r.choice([3, 9, 15]))
        budgets.append((a, len(texts), k))
        rows += [(a, p, t, m, e) for p, (t, m, e) in enumerate(zip(texts, must, extra))]
        want |= {(a, p): w for p, w in enumerate(brute_sample(texts, must, extra, k, distinct))}
    df = spark.createDataFrame(rows, "array string, pos long, item string, must boolean, extra int")
    got = adaptive.sampled(df, spark.createDataFrame(budgets, "array string, n long, k long"), distinct)
    assert {(x.array, x.pos): x.why for x in got.collect()} == want


def test_change_points(spark):
    r = random.Random(4)
    arrays = {"step": [10, 11, 12] * 6 + [50 + k for k in range(20)], "flat": [3.0] * 30, "short": [1.0] * 5 + [9.0] * 5, "noise": [r.random() for _ in range(60)]}
    df = spark.createDataFrame([(a, p, float(x)) for a, xs in arrays.items() for p, x in enumerate(xs)], "array string, pos long, x double")
    got = {(x.array, x.pos) for x in adaptive.changes(adaptive.away(df, "x"), "x").collect()}
    want = set()
    for a, xs in arrays.items():
        mean = sum(xs) / len(xs)
        deviation = (sum((x - mean) ** 2 for x in xs) / (len(xs) - 1)) ** 0.5
        for p in range(5, len(xs) - 5):
            if len(xs) > 10 and deviation > 0 and abs(sum(xs[p : p + 5]) - sum(xs[p - 5 : p])) / 5 > 2 * deviation:
                want.add((a, p))
    assert got == want


def test_query_with_deflating_equals_the_sequential_rule(spark, small):
    import __spark_entry__ as entry

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id: r.k for r in entry.queries()["deflated_k"](spark, small).collect()} == {k: brute_k(t.split("\n")) for k, t in texts.items() if t is not None}
