import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.operators import compressors, graphs, memory, profile, ranking, rollup, selection, similarity
from lodestream.sources import stores


def series(spark, values):
    return spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(values)], "g string, pos long, x double")


def points(spark, values):
    rows = profile.change_points(series(spark, values).withColumnRenamed("pos", "t"), "g", "x", ["t"]).collect()
    return rows[0].points if rows else []


def test_change_points_by_hand(spark):
    assert points(spark, [0] * 10 + [100] * 10) == []
    assert points(spark, [0] * 30 + [100] * 6) == [29]


def test_anomalies_by_hand(spark):
    rows = profile.numeric_anomalies(series(spark, [1] * 9 + [100]), "g", "x").collect()
    assert [r.pos for r in rows] == [9]


def test_k_split_rounds_halves_to_even(spark):
    first, last, rest = selection.k_split(F.lit(15))
    assert tuple(spark.range(1).select(first.alias("a"), last.alias("b"), rest.alias("c")).first()) == (4, 2, 9)


def test_knee(spark):
    flat = spark.createDataFrame([("a", k, 5) for k in range(3)], "g string, t long, n long")
    assert profile.knee(flat, "g", "t", "n").first().k == 1
    bent = spark.createDataFrame([("a", k, n) for k, n in enumerate([1, 50, 90, 92, 93, 94])], "g string, t long, n long")
    assert profile.knee(bent, "g", "t", "n").first().k == 3


def test_deltas_and_resets(spark):
    rows = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([10, 25, 5, 12])], "g string, t long, c double")
    assert [float(r.delta) for r in rollup.successive_deltas(rows, "g", ["t"], "c").orderBy("t").collect()] == [10, 15, 0, 7]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "alpha beta")], "id long, text string")
    asked = spark.createDataFrame([(9, "alpha")], "q long, text string")
    r = ranking.keyword_scores(docs, asked, "id", "text", "q", "text").first()
    assert r.raw == pytest.approx(0.6931) and r.score == pytest.approx(0.0693)
    long = ranking.keyword_scores(spark.createDataFrame([(1, "alphabetical")], "id long, text string"), spark.createDataFrame([(9, "alphabetical")], "q long, text string"), "id", "text", "q", "text").first()
    assert long.score == pytest.approx(0.3693)


def test_text_functions_by_hand(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(T.input_bucket(F.lit(n))) for n in (1999, 2000, 128_000)] == ["xs", "s", "xl"]
    assert one(T.hybrid_alpha(F.lit("order 1234 please"))) == 0.65
    assert one(T.net_gain(F.lit(2000), F.lit(50000), F.lit(287.5), F.lit(1.0))) == pytest.approx(0, abs=1e-6)
    assert one(T.break_even_reads(F.lit(2000), F.lit(50000))) == pytest.approx(287.5)
    assert one(ranking.recency(F.lit(30.0))) == pytest.approx(math.exp(-1)) and one(ranking.recency(F.lit(-1.0))) == 1
    assert one(T.model_family(F.lit("GPT-9-mini"))) == "gpt" and one(T.model_family(F.lit("x"))) == "other"
    assert one(T.log_level(F.lit("12:00 [warning] disk"))) == "WARN" and one(T.log_level(F.lit("erroring"))) is None
    assert one(T.volatile_kind(F.lit("3f2504e0-4f89-41d3-9a0c-0305e82c3301"))) == "uuid"
    assert one(T.has_strong_error(F.lit("fatal crash"))) and not one(T.has_strong_error(F.lit("error_handler.py")))


def test_f1_and_echo(spark):
    pair = spark.createDataFrame([(1, "a b c", "b c d")], "k long, x string, y string")
    assert similarity.bag_overlap(pair, ["k"], "x", "y").first().f1 == pytest.approx(2 / 3, abs=1e-6)
    assert similarity.contained_share(pair, ["k"], "x", "y", 2).first().echo == 0.5


def test_jaccard_pairs_as_brute_force(spark):
    import random

    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9)))) for i in range(60)]
    got = {(p.a, p.b) for p in similarity.word_jaccard_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.6).collect()}
    sets = {i: set(t.split()) for i, t in rows}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


def test_simhash_as_brute_force(spark):
    import hashlib

    def brute(t):
        t = t.lower()
        votes = [0] * 64
        for i in range(max(1, len(t) - 3)):
            h = int.from_bytes(hashlib.md5(t[i : i + 4].encode()).digest()[:8], "big")
            for k in range(64):
                votes[k] += 1 if h >> k & 1 else -1
        return sum(1 << k for k in range(64) if votes[k] > 0)

    rows = [(1, "The quick brown fox"), (2, "ab"), (3, "The quick brown fix"), (4, "naïve café")]
    for r in similarity.simhash(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect():
        assert r.hi << 32 | r.lo == brute(dict(rows)[r.id])


def test_simhash_links_reach_every_near_pair(spark):
    import random

    r = random.Random(4)
    seeds = [(r.getrandbits(32), r.getrandbits(32)) for _ in range(12)]
    near = [(hi ^ 1 << r.randrange(32), lo ^ r.choice([0, 1 << r.randrange(32)])) for hi, lo in seeds for _ in range(2)]
    rows = [(k, hi, lo) for k, (hi, lo) in enumerate(r.choices(seeds + near, k=150))]
    links = similarity.simhash_links(spark.createDataFrame(rows, "id long, hi long, lo long")).collect()
    distance = lambda x, y: (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count()
    least = {}
    for k, hi, lo in rows:
        least.setdefault((hi, lo), k)
    own = {k: least[hi, lo] for k, hi, lo in rows}
    assert {(x.a, x.b) for x in links if x.distance == 0} == {(a, k) for k, a in own.items() if a < k}
    between = {frozenset((x.a, x.b)): x.distance for x in links if x.distance}
    for x in rows:
        for y in rows[: x[0]]:
            d = 0 if own[x[0]] == own[y[0]] else between.get(frozenset((own[x[0]], own[y[0]])))
            assert d == (distance(x, y) if distance(x, y) <= 3 else None)
    texts = spark.createDataFrame([(1, "The quick brown fox"), (2, "the QUICK brown fox"), (3, "something else altogether"), (4, ""), (5, None)], "id long, t string")
    assert [tuple(x) for x in similarity.simhash_links(similarity.simhash(texts, "id", "t")).collect()] == [(1, 2, 0)]


def test_line_digests_in_bounded_chunks(spark):
    import hashlib

    rows = [(g, k % 70, f"{g} line {k}" if k % 9 else None) for g in ("a", "b", None) for k in range(200)] + [("one", 1, ""), ("one", 0, ""), ("no", 1, None)]
    lines = {}
    for g, k, line in sorted((r for r in rows if r[2] is not None), key=lambda r: r[1:]):
        lines.setdefault(g, []).append(line)
    df = spark.createDataFrame(rows, "g string, k long, line string").repartition(5)
    for chunk in (1, 50, 1 << 16):
        got = compressors.line_digests(df, "g", "k", "line", chunk)
        assert {r.group: r.md5 for r in got.collect()} == {g: hashlib.md5("\n".join(x).encode()).hexdigest() for g, x in lines.items()}
        assert "collect_list" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["table_compaction", "crushed_arrays"])
def test_queries_that_collect_no_group(spark, small, name):
    import __spark_entry__ as entry

    assert "collect_list" not in entry.queries()[name](spark, small)._jdf.queryExecution().toString()


def test_item_rows_crush_as_arrays_do(spark, small):
    import __spark_entry__ as entry

    rows = spark.read.parquet(f"{small}/events.parquet").select("user_id", F.struct("event_id", "event_type", "value").alias("r"))
    arrays = rows.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("items"))
    cells = {r.id: (json.loads(r.items), r.kept, r.of, r.dropped_key is None) for r in compressors.crushed_arrays(arrays, "user_id", "items").collect()}
    got = {}
    for r in sorted(entry.queries()["crushed_arrays"](spark, small).collect(), key=lambda r: r.at):
        got.setdefault(r.user_id, ([], r.kept, r.of, r.dropped_key is None))[0].append(json.loads(r.item))
    assert got == cells


def test_walks(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (9, 9)], "src long, dst long")
    assert {r.node: r.depth for r in graphs.neighbourhood(e, spark.createDataFrame([(4,)], "n long"), 2).collect()} == {4: 0, 3: 1, 2: 2, 1: 2}
    assert {r.node: r.path for r in graphs.shortest_paths(e, 1, 3).collect()} == {1: "1", 2: "1>2", 3: "1>3", 4: "1>3>4"}
    n = graphs.neighbourhood(e, spark.createDataFrame([(1,)], "n long"), 1)
    assert {(r.src, r.dst) for r in graphs.touched_edges(e, n, 1).collect()} == {(1, 2), (1, 3)}
    links = spark.createDataFrame([(3, 2), (2, 1), (1, None)], "id long, before long")
    assert {(r.root, r.id, r.age) for r in graphs.history(links, links.where("id = 3"), 5, "id", "before").collect()} == {(3, 3, 0), (3, 2, 1), (3, 1, 2)}


def test_read_states(spark):
    ops = [(1, "f", 0, "read", 0, 100), (1, "f", 1, "read", None, None), (1, "g", 2, "read", 10, 5), (1, "g", 3, "edit", None, None), (1, "g", 4, "read", 0, 50), (1, "g", 5, "read", 60, 5)]
    df = spark.createDataFrame(ops, "s long, path string, idx long, kind string, offset long, limit long")
    assert {r.idx: r.state for r in memory.read_states(df, "s", "path", "idx").collect()} == {0: "superseded", 1: "fresh", 2: "stale", 4: "fresh", 5: "fresh"}


def test_memory_tables(spark):
    rows = spark.createDataFrame(
        [("m1", "u", "s", None, None, "likes tea", 0.9, None, '{"team": "x"}', ["a"]), ("m2", "u", None, None, None, "old", 0.2, "m3", "{}", []), ("m3", "u", "s", "a", "t", "new", 0.5, None, '{"n": 3}', ["b", "c"])],
        "id string, user_id string, session_id string, agent_id string, turn_id string, content string, importance double, superseded_by string, metadata string, entity_refs array<string>",
    )
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(memory.where(rows, {"user_id": "u"})) == ["m1", "m3"] and ids(memory.where(rows, superseded=True)) == ["m1", "m2", "m3"]
    assert ids(memory.where(rows, metadata={"team": "x", "bad key'": 1})) == ["m1"] and ids(memory.where(rows, metadata={"n": 3})) == ["m3"]
    assert ids(memory.where(rows, entities=["c"], importance=(0.4, 1.0))) == ["m3"]
    assert ids(memory.bubbled(rows, 0.6)) == ["m1", "m1:user", "m2", "m3"]
    assert ids(memory.missing(rows, spark.createDataFrame([("new",)], "content string"), "content")) == ["m1", "m2"]
    fit = memory.within_budget(rows, "user_id", "content", "importance", 25).collect()
    assert sorted(r.id for r in fit) == ["m1", "m3"] and sum(r.cost for r in fit) == 23


def test_units_and_recoveries(spark):
    calls = spark.createDataFrame([(1, 0, "x"), (1, 0, "y"), (1, 5, "z")], "conv long, at long, call_id string")
    results = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "x")], "conv long, at long, call_id string")
    assert [tuple(r) for r in memory.tool_units(calls, results, "conv").collect()] == [(1, 0, [2, 3])]
    log = [(1, 0, "read", "/a/fil.py", True), (1, 1, "sh", "ls", False), (1, 2, "read", "/a/file.py", False), (1, 9, "read", "/b", False)]
    got = memory.recoveries(spark.createDataFrame(log, "s long, at long, tool string, input string, is_error boolean"), "s", "at").collect()
    assert [(r.at, r.failed_input, r.distance) for r in got] == [(2, "/a/fil.py", 1), (9, "/a/fil.py", 8)]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "ledger")
    now = datetime(2024, 5, 1)
    events = spark.createDataFrame([(1, (now - timedelta(days=d)).isoformat() + "Z", 100 + d, 40, 0.1, "m", "c", "s") for d in (0, 3, 40)], "v int, ts string, before long, after long, cost_usd double, model string, client string, source string")
    stores.append_ledger(events, path)
    (tmp_path / "ledger" / "part-bad.json").write_text('{"v": 1, "ts": "no time"}\nnot json\n')
    rows = stores.read_ledger(spark, path)
    assert sorted(r.saved for r in rows.collect()) == [60, 63, 100]
    assert stores.read_ledger(spark, path, "2024-04-15").count() == 2 and stores.compacted(rows, "at", 7).count() == 2
    blobs = stores.blobs(spark.createDataFrame([("p", now), ("p", now + timedelta(1)), ("q", now)], "payload string, at timestamp"), "payload", "at")
    assert blobs.count() == 2 and stores.within_capacity(blobs, 1).first().payload == "p"
    got = stores.retrieve(blobs, blobs.select("hash"), F.lit(now + timedelta(days=1, seconds=5)), 3600).collect()
    assert sorted((r.payload or "") for r in got) == ["", "p"]


def test_tables_in_text(spark):
    df = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n", "a,b\n1,2\n\n3,4,5\n", "name   size\nx y    3\n"), (2, None, None, None)], "id long, md string, csv string, fw string")
    md = {r.row: r.record for r in stores.markdown_records(df, "id", "md").collect()}
    assert md == {0: {"a": "1", "b": "2"}, 1: {"a": "3", "b": ""}}
    assert [r.record for r in stores.delimited_records(df, "id", "csv").orderBy("row").collect()] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    assert [r.record for r in stores.fixed_width_records(df, "id", "fw").collect()] == [{"name": "x y", "size": "3"}]


def test_logs(spark):
    lines = [f"INFO step {k}" for k in range(100)]
    lines[50] = "ERROR broke"
    for k in (70, 71, 72):
        lines[k] = f"WARN retry {k}"
    r = compressors.compressed_logs(spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "id long, t string"), "id", "t").collect()
    assert len(r) == 1 and r[0].lines == 100
    assert r[0].text.split("\n") == [lines[k] for k in [0, *range(47, 54), *range(67, 74), 99]]


def test_search_hits(spark):
    text = "a.py:3:def error():\nb.py-9-note here\nC:\\x.py:12:body\nno hit\n" + "\n".join(f"z.py:{k}:plain" for k in range(20))
    hits = compressors.search_hits(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t")
    assert [(r.file, r.number) for r in hits.orderBy("at").limit(3).collect()] == [("a.py", 3), ("b.py", 9), ("C:\\x.py", 12)]
    kept = compressors.chosen_hits(hits, "body", per_file=5).collect()
    assert sum(r.file == "z.py" for r in kept) == 5 and {r.number for r in kept if r.file == "z.py"} >= {0, 19}


def test_diffs(spark):
    diff = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,9 +1,9 @@\n c1\n c2\n c3\n-old\n+new\n c4\n c5\n c6\n@@ -20,3 +20,3 @@\n x\n-error\n+fixed\n"
    lines = compressors.diff_lines(spark.createDataFrame([(1, diff)], "id long, t string"), "id", "t")
    assert lines.where("change IS NOT NULL").count() == 4 and {r.file for r in lines.where("hunk > 0").collect()} == {"f"}
    kept = [r.line for r in compressors.chosen_hunks(lines).orderBy("at").collect()]
    assert kept[:8] == ["@@ -1,9 +1,9 @@", " c2", " c3", "-old", "+new", " c4", " c5", "@@ -20,3 +20,3 @@"]


def test_prose_keeps_order_and_budget(spark):
    text = "Nothing here to see. The value was 42 at peak. Nothing here to see. ERROR in module.name happened. Filler words go on and on."
    r = compressors.crushed_text(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", 0.6, "peak value").first()
    assert "42" in r.text and len(r.text) <= 0.6 * len(text) + 5 and r.text.count("Nothing here") <= 1 and r.of == 5


def test_arrays_keep_what_must_stay(spark):
    items = [{"seq": k, "status": "ok", "ms": 10} for k in range(60)]
    items[30]["ms"], items[40]["status"] = 9000, "error"
    r = compressors.crushed_arrays(spark.createDataFrame([(1, json.dumps(items)), (2, "[]"), (3, None)], "id long, j string"), "id", "j").collect()
    assert len(r) == 1 and r[0].kept == 15 and r[0].of == 60 and len(r[0].dropped_key) == 12
    kept = [x["seq"] for x in json.loads(r[0].items)]
    assert {0, 1, 2, 3, 30, 40, 58, 59} <= set(kept) and kept == sorted(kept)


def test_page_text(spark):
    html = "<html><head><style>p{}</style><script>var t='<p>';</script></head><body><nav>x</nav><!-- no --><p>One&nbsp;&amp; <b>two</b></p></body></html>"
    assert spark.range(1).select(compressors.page_text(F.lit(html))).first()[0] == "One & two"


def test_similar_sets_of_all_sizes_are_found_through_places_and_marks(spark):
    import random

    rng, texts = random.Random(3), []
    for k in range(60):
        words = rng.sample(range(400 if k % 2 else 3000), rng.choice([1, 2, 5, 20, 200, 900][: 5 if k % 2 else 6]))
        texts.append(words)
        for share in (0.05, 0.15, 0.3):
            texts.append([w for w in words if rng.random() > share] + rng.sample(range(3000), len(words) // 20) or words)
    sets = [set(t) for t in texts]
    rows = [(i, " ".join(map(str, t))) for i, t in enumerate(texts)]
    jaccard = {(i, j): round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6) for i in range(len(sets)) for j in range(i + 1, len(sets))}
    for least in (0.5, 0.7, 1.0):
        got = {(p.a, p.b): p.jaccard for p in similarity.word_jaccard_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t", least).collect()}
        assert got == {p: s for p, s in jaccard.items() if s >= least}
        assert got


def test_cells_are_read_from_objects_once(spark):
    from lodestream.operators import tables

    found = tables.cells(spark.createDataFrame([("t", 0, '{"a": 1}'), ("t", 1, "no object"), ("t", 2, None)], "t string, at long, item string"), "t", "at", "item")
    assert found._written_to and "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.at, r.field, r.csv) for r in found.collect()] == [(0, "a", "1")]
