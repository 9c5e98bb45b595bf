import random

import pytest

from lodestream.operators import diffs, similarity


def hunk(old, new, lines, around="@@"):
    return [f"{around} -1,{old} +1,{new} {around}", *lines]


@pytest.mark.parametrize(
    "text,want",
    [
        ("", False), ("plain prose\nwith @@ signs\n--- and dashes", False), ("--- a/f\n+++ b/f", False), ("@@ -1,1 +1,1 @@\n-a\n+b", False),
        ("--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n-old\n+new\n context", True), ("--- a/f\n+++ b/f\n@@ -1 +1 @@\n-a\n+b\n\\ No newline at end of file", True),
        ("--- a/f\n+++ b/f\n@@ -1,3 +1,2 @@\n-old\n+new\n context", False), ("--- a/f\n+++ b/f\n@@ -1,1 +1,1 @@\n-a\nstray\n+b", False), ("--- a/f\n+++ b/f\n@@ -1,1 +1,1 @@\n-a\n-b", False),
        ("--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n-- x\n++ y\n \n--- a/g\n+++ b/g\n@@ -0,0 +1 @@\n+z\n", True), ("--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n\n-a\n+b\nnote after it", True),
    ],
)
def test_diffs_are_told_by_their_counts(text, want):
    assert diffs.is_diff(text) is want


def test_names_inside_hunks_are_counted_lines():
    """A removed line that begins with two dashes looks like a file's name: the counts say that it isn't."""
    text = "--- a/f\n+++ b/f\n@@ -1,3 +1,1 @@\n--- a/g\n-x\n y"
    assert diffs.is_diff(text)


def big(n_hunks):
    lines = ["commit 1", "", "diff --git a/f.py b/f.py", "similarity index 90%", "rename from f.py", "rename to g.py", "--- a/f.py", "+++ b/f.py"]
    for k in range(n_hunks):
        lines += [f"@@ -{k * 20 + 1},8 +{k * 20 + 1},8 @@ def f{k}", " a", " b", " c", f"-x{k}", f"+y{k}", " d", " e", " f"]
    return lines + ["\\ No newline at end of file"]


def test_shortened_text():
    text = "\n".join(big(6))
    got = diffs.shortened(text)
    kept = big(6)
    want = kept[:8] + [x for k in range(6) for x in kept[8 + 9 * k : 9 + 9 * k] + kept[10 + 9 * k : 16 + 9 * k]] + kept[-1:]
    assert got[0] == "\n".join([*want, "[1 files changed, +6 -6 lines]"]) and got[1:] == (1, 6, 6, 6, 0, None)
    text = "\n".join(big(14))
    got = diffs.shortened(text, asked="where is x7 and y9 there", stored_below=0.9)
    assert got[1:6] == (1, 14, 14, 10, 4) and "-x7" in got[0] and got[0].startswith("commit 1\n\n") and "14 lines, 4 hunks omitted]" in got[0]
    lines = got[0].split("\n")
    assert lines[-1] == f"[{len(big(14))} lines compressed to {len(lines) - 1}. Retrieve full diff: hash={got[6]}]" and len(got[6]) == 24
    assert "@@ -1,8 +1,8 @@ def f0" in lines and "@@ -261,8 +261,8 @@ def f13" in lines
    assert diffs.shortened("short\ndiff") == ("short\ndiff", 0, 0, 0, 0, 0, None)
    assert diffs.shortened("prose\n" * 60)[1] == 0


def test_files_modes_and_binaries():
    lines = []
    for k in range(25):
        lines += [f"diff --git a/f{k} b/f{k}", "new file mode 100755", "--- /dev/null", f"+++ b/f{k}", f"@@ -0,0 +1,{k} @@", *[f"+{j}" for j in range(k)]]
    lines += ["diff --git a/i.png b/i.png", "Binary files a/i.png and b/i.png differ", "diff --cc m.py", "@@@ -1,1 -1,1 +1,2 @@@", "++x" + "y" * 40, "+ z"] + ["+ w"] * 30
    text, files, added, *_ = diffs.shortened("\n".join(lines))
    assert files == 20 and "new file mode 100644" in text and "100755" not in text and "a/f3 " not in text and "diff --cc m.py" in text and added == sum(range(6, 25)) + 32
    few = diffs.shortened("\n".join(lines[-36:] + ["+ v"] * 20))[0]
    assert "\nBinary files differ\ndiff --cc m.py" in few


def test_rows(spark):
    rows = spark.createDataFrame([(1, "\n".join(big(6))), (2, None), (3, "x")], "id long, t string")
    assert {r.id: r.hunks_kept for r in diffs.compressed(rows, "id", "t").collect()} == {1: 6, 3: 0}
    assert {r.id: r.diff for r in diffs.detected(rows, "id", "t").collect()} == {1: False, 2: False, 3: False}


def brute_merge(rows, above):
    words = {i: set(t.lower().split()) for i, t, *_ in rows}
    used, out = set(), []
    rows = sorted(rows)
    for k, row in enumerate(rows):
        if row[0] in used:
            continue
        group = [row]
        for other in rows[k + 1 :]:
            a, b = words[row[0]], words[other[0]]
            if other[0] not in used and a and b and len(a & b) / len(a | b) > above:
                group.append(other)
                used.add(other[0])
        best = max(group, key=lambda r: r[2])
        out.append((row[0], best[0], best[2], sorted({x for r in group for x in r[3] if x is not None}), max(r[4] for r in group), len(group)))
    return sorted(out)


def test_merging_equals_the_pass_in_order(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(14)]
    rows, text = [], r.sample(words, 8)
    for i in range(120):
        text = r.sample(words, 8) if r.random() < 0.2 else [*text[1:], r.choice(words)]
        rows.append((i, " ".join(text) if i % 17 else "", r.randrange(5), r.sample(["a", "b", "c", None], 2), r.randrange(9)))
    df = spark.createDataFrame(rows, "id long, text string, importance int, refs array<string>, uses int").repartition(4)
    for above in (0.5, 0.7):
        got = similarity.merged(df, "id", "text", "importance", "refs", "uses", above).collect()
        assert sorted((x.leader, x.id, x.importance, x.references, x.uses, x.members) for x in got) == brute_merge(rows, above)


def test_query_on_documents_equals_the_pass_in_order(spark, small):
    import __spark_entry__ as entry
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", (F.xxhash64("doc_id") % 10).alias("importance"), F.array("source", "lang").alias("refs"), F.length("text").alias("uses"))
    want = [(a, b, c, ",".join(refs), uses, n) for a, b, c, refs, uses, n in brute_merge([tuple(r) for r in d.collect()], 0.7)]
    got = entry.queries()["merged_memories"](spark, small).collect()
    assert sorted((r.leader, r.doc_id, r.importance, r.references, r.uses, r.members) for r in got) == want


def test_alike_rows_are_told_against_leaders_only(spark, monkeypatch):
    """Rows that are all alike are pairs in the square of their number; few of them carry words."""
    told, keep = [], similarity.written

    def watched(df, label):
        out = keep(df, label)
        if label == "similar-pairs":
            told.append(out.count())
        return out

    monkeypatch.setattr(similarity, "written", watched)
    base = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join([*base, f"own{i}", f"too{i % 7}"]), i % 5, ["a"], i) for i in range(80)]
    got = similarity.merged(spark.createDataFrame(rows, "id long, text string, importance int, refs array<string>, uses int").repartition(4), "id", "text", "importance", "refs", "uses").collect()
    assert sorted((x.leader, x.id, x.importance, x.references, x.uses, x.members) for x in got) == brute_merge(rows, 0.7)
    assert told == [79]


@pytest.mark.parametrize("least", [0.3, 0.7, 0.9])
def test_pairs_across_small_batches_equal_brute_force(spark, least):
    """A word's sets come in many batches, of which a task holds those that later ones can be similar to."""
    r = random.Random(9)
    sets = {i: set(r.sample(range(12), r.randrange(1, 9))) for i in range(150)}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
    df = spark.createDataFrame([(i, [f"w{k}" for k in s]) for i, s in sets.items()], "id long, words array<string>").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(p.a, p.b): p.jaccard for p in similarity.jaccard_pairs(df, least).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def test_states_of_reads_equal_pairwise_comparison(spark):
    from lodestream.operators import memory

    r = random.Random(6)
    ops = []
    for k in range(600):
        whole = r.random() < 0.02
        ops.append((r.choice(["s", "t", None]), r.choice(["f", "g", None]), k // 2, "edit" if r.random() < 0.01 else "read", None if whole else r.randrange(60), None if whole else r.choice([5, 20, 40, None])))
    df = spark.createDataFrame([(*o, i) for i, o in enumerate(ops)], "s string, f string, o long, kind string, offset long, limit long, i long").repartition(4)

    def span(o):
        b = o[4] or 0
        return b, 2**62 if b == 0 and o[5] is None else b + (2000 if o[5] is None else o[5])

    want = {}
    for i, o in enumerate(ops):
        if o[3] == "read":
            later = [x for x in ops if x[:2] == o[:2] and x[2] > o[2]]
            b, e = span(o)
            want[i] = "stale" if any(x[3] == "edit" for x in later) else "superseded" if any(span(x)[0] <= b and span(x)[1] >= e for x in later) else "fresh"
    got = {x.i: x.state for x in memory.read_states(df, "s", "f", "o").collect()}
    assert got == want and set(want.values()) == {"stale", "superseded", "fresh"}
