import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lodestream.llm import filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_mask(rows):
    """Filters that each (id, text) fails, as letters."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search("[#$%&*|]", t)), i is not None and i > least[t],
        ]
        out.append("".join(f for f, x in zip("ABCDE", fails) if x))
    return out


def brute(rows, labels):
    """Rows of the audit, order by order and document by document."""
    masks = brute_mask([(i, t) for i, t, _ in rows])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, shares = {}, defaultdict(Counter)
    for part in {lang or "" for *_, lang in rows}:
        docs = [(i, m) for (i, _, lang), m in zip(rows, masks) if (lang or "") == part]
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shares[part][f] += len(gone)
                failing = [d for d in docs if f in d[1]]
                out[part, "".join(order), step] = (
                    len(left), len(gone), len(failing) - len(gone), sum(d[1] == f for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                )
    return sorted((*k, *v, shares[k[0]][k[1][k[2] - 1]]) for k, v in out.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


@pytest.fixture(scope="module")
def mixed():
    r = random.Random(6)
    words = [f"w{k}" for k in range(200)] + ["ABC", "Xy", "#tag", "a|b", "50%", "é", "漢"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([3, 50, 99, 100, 101, 180]))) for _ in range(60)]
    texts += [" ".join(words[:n]) for n in (100, 99, 80)] + ["A" * k + "b" * (10 - k) for k in range(3)] + ["", " ", " ", "a b", None]
    texts += ["same head " * 150 + tail for tail in ("one", "two", "six")]  # equal length and first blocks
    rows = [(k, r.choice(texts), r.choice(["en", "de", None, ""])) for k in range(250)]
    rows += [(None, texts[0], "en"), (None, None, None), (7, rows[7][1], "en"), (7, "other", "de")]
    r.shuffle(rows)
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 250, 2)] + [(4, 1, 1), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("bits", [64, 4, 1])
def test_masks_with_and_without_colliding_hashes(spark, mixed, bits):
    rows, _ = mixed
    df = spark.createDataFrame([(*row, "x", 1) for row in rows], "doc_id long, text string, lang string, id string, mask int").repartition(4)
    got = filters.flagged(df, hash_bits=bits)
    want = Counter((i, lang or "", sum(1 << "ABCDE".index(f) for f in m)) for (i, _, lang), m in zip(rows, brute_mask([(i, t) for i, t, _ in rows])))
    assert Counter(tuple(r) for r in got.select("id", "lang", "mask").collect()) == want


def test_counts_equal_those_order_by_order(spark, mixed):
    rows, labels = mixed
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(filters.interactions(filters.flagged(df), known)) == brute(rows, labels)


def test_refinement_drops_what_is_alone(spark):
    a, b = "x" * 64, "y" * 2000
    rows = [(1, a + b), (2, a + b), (3, a + b[:-1] + "z"), (4, "z" + a[1:] + b), (5, "short"), (6, "other"), (7, "a text of its own length")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    left = filters.refined(filters.measured(df))
    assert {r.id for r in left.collect()} == {1, 2}
    assert {r.id for r in filters._shared(filters.measured(df), "class_1").collect()} == {1, 2, 3}
    assert {r.id for r in filters._shared(filters.measured(df), "class_0").collect()} == {1, 2, 3, 4, 5, 6}


def test_bit_table_lets_no_member_go(spark, monkeypatch):
    texts = spark.range(20_000).select(F.col("id").cast("string").alias("text"), (F.xxhash64("id")).alias("class"))
    classes = spark.range(0, 20_000, 10).select(F.xxhash64("id").alias("class"))
    for most in (filters.FILTER_BITS, 1 << 15):
        monkeypatch.setattr(filters, "FILTER_BITS", most)
        got = filters._may_be(texts, classes)
        assert got.columns == ["text", "class"]
        assert got.join(classes, "class", "left_semi").count() == 2000
        assert got.count() < (3500 if most > 1 << 15 else 4000)


def test_one_text_that_holds_a_third_of_the_rows(spark):
    rows = [(k, "boilerplate" if k % 3 else f"text {k}", "en") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    assert filters.flagged(df).where("mask >= 16").count() == 1999


def test_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(filters.interactions(filters.flagged(odd), labels))
    assert got == brute([(i, t, lang) for i, t, lang, *_ in odd_rows], [(1, 1, 0), (2, 0, 1)])
    assert filters.interactions(filters.flagged(none), labels).count() == 0
