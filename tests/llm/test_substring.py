import hashlib

import numpy as np
import pytest

from lodestream.llm import substring


def brute(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in docs:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [3, 8, 13, 25, 40])
def test_removes_as_brute_force(odd, odd_rows, window):
    assert sorted(map(tuple, substring.remove_repeats(odd, window).collect()), key=str) == brute(odd_rows, window)


def test_across_many_chunks(spark, monkeypatch):
    import random

    r = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([f"a{r.randrange(300)}" for _ in range(40)] + passage[r.randrange(5) : 18 + r.randrange(12)] + [f"b{r.randrange(300)}" for _ in range(20)])) for i in range(120)]
    monkeypatch.setattr(substring, "CHUNK", 200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring.remove_repeats(df).collect()), key=str) == brute(rows, 13)


def test_one_id_on_texts_of_other_lengths(spark):
    shared, clean = [f"s{i}" for i in range(20)], [f"c{i}" for i in range(60)]
    rows = [
        (1, " ".join(shared)),
        (2, " ".join(clean[:40] + shared)), (2, " ".join(clean[40:54])), (2, " ".join(clean)), (2, " ".join(shared[:15] + clean[:5])),
        (3, " ".join(clean[30:50])), (3, " ".join(clean[30:50])), (None, " ".join(shared)), (2, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for window in (7, 13, 25):
        assert sorted(map(tuple, substring.remove_repeats(df, window).collect()), key=str) == brute(rows, window)


def test_names_that_clash_remove_nothing(spark):
    """Four different first names only: the second half of a name still tells windows apart."""
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(40))) for i in range(6)] + [(9, " ".join(f"w2_{k}" for k in range(5, 30)))]
    words = [t.encode().split() for _, t in rows]
    name = np.concatenate([substring.level_names(w, [7, 13]) % np.uint64(4) for w in words])
    second = np.concatenate([substring.first_names(w, 13, substring._SECOND) for w in words])
    id_ = np.concatenate([np.full(len(w) - 12, i) for (i, _), w in zip(rows, words)])
    order = np.lexsort((id_, second, name))
    told, _ = substring._answers(name[order], second[order], id_[order], True)
    assert sorted(id_[order][told]) == [9] * 13
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substring.remove_repeats(df).collect()), key=str) == brute(rows, 13)


def test_levels_double():
    assert substring.lengths(13) == [7, 13] and substring.lengths(50) == [7, 13, 25, 50] and substring.lengths(5) == [5]
    words = [f"w{i}".encode() for i in range(60)]
    for levels in ([7, 13, 25], [5, 10]):
        assert len(substring.level_names(words, levels)) == 60 - levels[-1] + 1
        assert (substring.level_names(words[3:], levels) == substring.level_names(words, levels)[3:]).all()


def test_empty_table_and_text(none, odd):
    assert substring.remove_repeats(none).count() == 0
    kept = {r.id: r.kept for r in substring.remove_repeats(odd, with_text=True).where("id = 2 or id = 10").collect()}
    assert kept == {2: "", 10: "two words"}
