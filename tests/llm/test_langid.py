import math
import random
import zlib

import numpy as np
import pytest

from lodestream.llm import langid

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "en er ch te ei ie sch ung ge ß".split(), "fr": "eau oi ou que é è ai ê ment tion".split()}


def text(lang: str, seed: int, n: int = 80) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 5))) for _ in range(n)) + "."


def brute_probability(counts, order, history, char):
    """Interpolated Kneser-Ney straight from its definition."""
    by = {k: {} for k in range(1, order + 1)}
    for g, n in counts.items():
        by[len(g)][g] = by[len(g)].get(g, 0) + n
    for k in range(order, 1, -1):
        for g in by[k]:
            by[k - 1][g[1:]] = by[k - 1].get(g[1:], 0) + 1

    def p(h, c):
        k = len(h) + 1
        if not any(g[:-1] == h for g in by[k]):
            lower = 1 / (len(by[1]) + 1) if k == 1 else p(h[1:], c)
            return lower
        n1, n2 = sum(v == 1 for v in by[k].values()), sum(v == 2 for v in by[k].values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        seen = {g: v for g, v in by[k].items() if g[:-1] == h}
        total = sum(seen.values())
        lower = 1 / (len(by[1]) + 1) if k == 1 else p(h[1:], c)
        return max(seen.get(h + c, 0) - d, 0) / total + d * len(seen) / total * lower

    return p(history[-(order - 1) :], char)


def test_model_gives_kneser_ney_probabilities():
    order, counts = 3, {}
    for w in ("abab", "abc", "bca", "cab", "aab"):
        run = langid.MARK + w + langid.MARK
        for e in range(2, len(run) + 1):
            g = run[max(0, e - order) : e]
            counts[g] = counts.get(g, 0) + 1
    identifier = langid.Identifier({"x": langid.CharModel(counts, order)}, order)
    for w in ("abab", "cba", "zab", "a", "aaaa"):
        run = langid.MARK + w + langid.MARK
        want = sum(math.log(brute_probability(counts, order, run[:k], run[k])) for k in range(1, len(run)))
        got = identifier.piece_scores([w])[0]
        assert got[0] == pytest.approx(want, abs=1e-4) and got[1] == len(w) + 1


@pytest.fixture(scope="module")
def fitted(spark):
    from lodestream.session import ship_package

    ship_package(spark)
    rows = [(i, text(lang, i), lang) for i in range(240) for lang in [("en", "de", "fr")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, langid.fit(langid.training_rows(docs))


def test_held_out_accuracy_and_scores(fitted):
    docs, identifier = fitted
    rows = langid.identify(docs, identifier).join(docs.withColumnRenamed("doc_id", "id"), "id").collect()
    held = [r for r in rows if zlib.crc32(str(r.id).encode()) % 4 == 2]
    assert len(held) > 30 and all(r.lang_pred == r.lang and not r.rejected for r in held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_the_fold_is_not_learned_from(fitted):
    docs, _ = fitted
    ids = [r.id for r in langid.training_rows(docs).select("id").collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)


def test_rejects_what_is_unlike_any_language(fitted, spark):
    _, identifier = fitted
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 -- !!"), (4, "ⴰⴱⴳ ⴷⴹⴻ ⴼⴽⵀ"), (5, text("de", 999)), (6, "a1 b2")], "doc_id long, text string")
    got = {r.id: (r.lang_pred, r.rejected) for r in langid.identify(odd, identifier).collect()}
    assert got[1] == got[2] == got[3] == ("und", True) and got[4][1] and got[5] == ("de", False)
    assert got[6][0] in identifier.languages  # letters beside digits only
    assert [r.doc_id for r in langid.accepted(odd.where("doc_id <= 5").selectExpr("*", "'' AS lang"), identifier).collect()] == [5]


def test_rejection_rates(fitted):
    """On texts that neither models nor limit have seen: few of a language go, most of no language do."""
    _, identifier = fitted
    own = [text(lang, 5000 + i, 30) for i in range(100) for lang in SYLLABLES]
    assert np.mean(identifier.predict(own)[3]) <= 0.03
    for kind in ("shuffled", "random"):
        unlike = [langid.negatives(t, 1)[kind] for t in own]
        assert np.mean(identifier.predict(unlike)[3]) >= 0.9, kind
    assert set(identifier.rates) == {"own", "shuffled", "random", "foreign"} and identifier.rates["own"] <= 0.05


def test_prediction_score_and_limit_as_brute_force(fitted):
    _, identifier = fitted
    for t in (text("en", 7000, 12), text("fr", 7001, 3), "the eau 9x9", langid.negatives(text("de", 7002, 20))["random"]):
        runs = [r.lower() for r in langid._LETTERS.findall(t)]
        n = sum(len(r) + 1 for r in runs)
        h = []
        for k in range(len(identifier.languages)):
            h.append(-sum(float(identifier.piece_scores([r])[0][k]) for r in runs) / n)
        best = h.index(min(h))
        score = 1 / sum(math.exp(-identifier.scale * (x - h[best])) for x in h)
        usual, between, single = identifier.usual[best]
        rejected = (h[best] - usual) / math.sqrt(between**2 + single**2 / n) > identifier.limit
        lang, got, least, out = identifier.predict([t])
        assert lang == [identifier.languages[best]] and got[0] == pytest.approx(score, abs=1e-4)
        assert least[0] == pytest.approx(h[best], abs=1e-4) and bool(out[0]) == rejected


def test_letters_beside_digits_count(fitted):
    """A text half of whose words hold a digit, in another language than the rest, is judged by all its letters."""
    _, identifier = fitted
    german = [w[:2] + "7" + w[2:] for w in text("de", 8000, 60).split()]
    mixed = " ".join(german + text("en", 8001, 12).split())
    assert identifier.predict([mixed])[0] == ["de"] and identifier.entropies([mixed])[0, -1] > 2 * identifier.entropies([text("en", 8001, 12)])[0, -1]


def test_ties_go_to_the_first_language():
    model = langid.CharModel({langid.MARK + "a": 3, langid.MARK + "b": 1}, 2)
    identifier = langid.Identifier({"zz": model, "aa": model}, 2)
    assert identifier.predict(["ab"])[0] == ["aa"] and identifier.predict(["ab"])[1][0] == pytest.approx(0.5)


def test_sample_takes_the_least_hashes_of_each_language(spark):
    from pyspark.sql import functions as F

    keys = spark.range(30_000).select("id", F.when(F.col("id") % 10 > 0, "big").otherwise(F.when(F.col("id") % 1000 == 0, "small").otherwise("mid")).alias("lang"))
    rows = keys.withColumn("h", F.xxhash64("id")).collect()
    want = {}
    for r in sorted(rows, key=lambda r: r.h):
        if len(want.setdefault(r.lang, [])) < 50:
            want[r.lang].append(r.id)
    got = {}
    for r in sorted(langid.sample_of(keys, 50).collect(), key=lambda r: r.r):
        got.setdefault(r.lang, []).append(r.id)
    assert got == want


def test_odd_rows_and_empty_tables(odd, odd_rows, none):
    identifier = langid.fit(langid.training_rows(odd))
    assert langid.identify(odd, identifier).count() == len(odd_rows)
    empty = langid.fit(langid.training_rows(none))
    assert empty.languages == [] and langid.identify(none, empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.accepted(none).count() == 0
    assert np.isfinite(identifier.scale)
