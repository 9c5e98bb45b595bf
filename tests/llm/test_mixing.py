import hashlib
import re

import pytest

from lodestream.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Reshare by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        each = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if each[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else each[s] for s in order}
        capped |= over


def brute_taken(rows, targets):
    sizes, order = {}, sorted(rows, key=lambda r: (hashlib.md5(str(r[0] if r[0] is not None else "").encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2]))
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    begin, out = dict.fromkeys(sizes, 0), []
    for i, s, n in order:
        goal = int(targets[s] + 0.5)
        out.append((i, s, n, sum(max(0, min(n, goal - e * sizes[s] - begin[s])) for e in range(3))))
        begin[s] += n
    return out


def test_plan_as_brute_force(odd, odd_rows):
    rows = [(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in odd_rows]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    targets = brute_targets(sizes)
    got = mixing.plan(odd).collect()
    assert sorted(((r.id, r.source, r.size, r.taken) for r in got), key=str) == sorted(brute_taken(rows, targets), key=str)
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.taken <= 2 * r.size and len(r.positions) <= 2
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
    for s in sizes:
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(targets[s], abs=1)


def test_cells_do_not_change_the_plan(odd, monkeypatch):
    want = sorted(map(tuple, mixing.plan(odd).collect()), key=str)
    monkeypatch.setattr(mixing, "CELL_ROWS", 1)
    assert sorted(map(tuple, mixing.plan(odd).collect()), key=str) == want


def test_positions_follow_the_schedules(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(900)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    early = {s: sum(p < 0.5 for r in got if r.source == s for p in r.positions) / sum(len(r.positions) for r in got if r.source == s) for s in "abc"}
    assert early["a"] > 0.65 and early["c"] < 0.35  # the heavy source fades out, the light one in


def test_inverse_meets_the_integral(spark):
    schedule = [(0.0, 0.5), (0.3, 2.0), (0.8, 0.0), (1.0, 1.0)]
    total = sum((a + b) / 2 * (t - s) for (s, a), (t, b) in zip(schedule, schedule[1:]))
    from pyspark.sql import functions as F

    for r in spark.range(0, 101).select((F.col("id") / 100).alias("d")).withColumn("t", mixing._inverse(schedule, F.col("d"))).collect():
        done = 0.0
        for (s, a), (t, b) in zip(schedule, schedule[1:]):
            x = min(max(r.t, s), t)
            done += (a + a + (b - a) * (x - s) / (t - s)) / 2 * (x - s)
        assert done / total == pytest.approx(r.d, abs=1e-9)


def test_mix_is_in_training_order(odd, none):
    """The rows come in the order of the plan's positions, also when read again from files."""
    planned = mixing.plan(odd).where("taken > 0").collect()
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    at = {}
    for r in planned:
        at.setdefault((r.id, r.source, r.size), set()).update(r.positions)
    key = lambda r: (r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    assert sorted(map(str, (key(r) for r in out.collect()))) == sorted(str((r.id, r.source, r.size)) for r in planned for _ in r.positions)
    from lodestream.session import written

    for rows in (out.collect(), [r for r in mixing.positions(written(out, "mixed")).orderBy("position").collect()]):
        now = -1.0
        for r in rows:  # each row can stand at one of its document's positions without going back
            now = min(p for p in at[key(r)] if p >= now)
    assert [r.position for r in mixing.positions(out).select("position").orderBy("position").collect()] == list(range(out.count()))
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0 and mixing.positions(none).count() == 0


def test_sources_without_words(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "a"), (3, "x y z", "b")], "doc_id long, text string, source string")
    assert {r.id: (r.target, r.taken) for r in mixing.plan(df).collect()} == {1: (0.0, 0), 2: (0.0, 0), 3: (4.5, 5)}
    assert {r.target for r in mixing.plan(df.where("source = 'a'")).collect()} == {0.0}
    assert sorted(r.doc_id for r in mixing.mix(df).collect()) == [3, 3]
    assert mixing.ordered(mixing.plan(df)).count() == 3


def test_positions_follow_numbers_beyond_the_width_of_file_names(spark, tmp_path):
    """Task numbers are padded to five digits: part-100000 comes after part-99999, though not as text."""
    rows = [(k, f"text {k}") for k in range(40)]
    names = ["part-00002-x-c000.parquet", "part-99999-x-c000.parquet", "part-99999-x-c001.parquet", "part-99999-x-c1000.parquet", "part-100000-x-c000.parquet"]
    (tmp_path / "mixed").mkdir()
    for k, name in enumerate(names):
        spark.createDataFrame(rows[8 * k : 8 * k + 8], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"one-{k}"))
        made = next((tmp_path / f"one-{k}").glob("part-*.parquet"))
        made.rename(tmp_path / "mixed" / name)
    got = mixing.positions(spark.read.parquet(str(tmp_path / "mixed"))).collect()
    assert {r.doc_id: r.position for r in got} == {k: k for k in range(40)}
