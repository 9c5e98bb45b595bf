"""Renderings, cell rules, runs and JSON paths on small tables with nulls, empties and repeats."""

from pyspark.sql import functions as F

from lodestream.functions import fields as X
from lodestream.operators import nested


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_quoted(spark):
    assert column(spark, [None, "", "a", "a,b", 'say "x"', "two\nlines"], X.quoted) == ["", "", "a", '"a,b"', '"say ""x"""', '"two\nlines"']


def test_key_value_lines(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, None)], "a int, b string, c string")
    out = df.select(X.key_value_lines({"a": F.col("a"), "b": F.col("b"), "p.c": F.col("c")}).alias("x")).collect()
    assert [r["x"] for r in out] == ["a: 1\np.c: x", ""]


def test_cell_class(spark):
    cells = [None, "", "word", '{"a": [1]}', "[broken", "QUJD" * 20, "<!DOCTYPE html><p>", "long " * 60]
    assert column(spark, cells, X.cell_class) == ["null", "scalar", "scalar", "json", "scalar", "base64", "html", "long"]


def test_images_and_parts(spark):
    assert column(spark, ["<img src=data:image/png;base64,AAAA==>", None], X.without_images) == ["<img src=[image]>", None]
    assert column(spark, ["```\ncode\n```\n{\n", "plain", ""], X.content_parts) == [2, 0, 0]


def test_runs_against_a_loop(spark):
    arrays = [[], ["a"], ["a", "a"], ["a", "b", "b", "a"], ["x"] * 50 + ["y"], None]
    df = spark.createDataFrame(list(enumerate(arrays)), "i int, v array<string>")
    got = {r["i"]: [tuple(x) for x in r["x"] or []] for r in df.select("i", X.runs(F.col("v")).alias("x")).collect()}
    for i, values in enumerate(arrays):
        want = []
        for at, v in enumerate(values or []):
            if want and want[-1][2] == v:
                want[-1] = (want[-1][0], at + 1, v)
            else:
                want.append((at, at + 1, v))
        assert got[i] == want


def test_line_kinds(spark):
    assert column(spark, ["a.py:3:x\n2024-01-01 up\nimport os\nwords"], X.line_kinds) == [["search", "log", "code", "plain"]]


def test_code_language(spark):
    texts = ["def f():\n    pass\nimport os\nclass A:\n", "fn main() {}\nuse a::b;\nimpl X {}\n", "words only", None]
    assert column(spark, texts, X.code_language) == ["python", "rust", None, None]


def test_bloat(spark):
    hits = "\n".join(f"a.py:{i}:x" for i in range(11))
    assert column(spark, [hits, "a.py:1:x", ""], X.search_bloat) == [1.0, 0.0, 0.0]
    assert column(spark, ["},\n" * 98, "}", ""], X.json_bloat) == [1.0, 0.0, 0.0]


def test_json_paths(spark):
    texts = [(1, '{"a": {"b": 1, "c": [1, {"d": null}]}}'), (2, "no"), (3, "[]"), (4, None), (5, "7")]
    df = spark.createDataFrame(texts, "key int, value string")
    got = sorted(tuple(r) for r in nested.json_paths(df, "key", "value").collect())
    assert got == [(1, "$.a.b", "1"), (1, "$.a.c[0]", "1"), (1, "$.a.c[1].d", None), (3, "$", "[]"), (5, "$", "7")]
    assert nested.json_paths(df.where("key = 1"), "key", "value", 1).collect()[0]["path"] == "$.a"


def test_opaque_words(spark):
    assert column(spark, ["key a1b2c3d4e5 aaaaaaa1 wordwordword 12345678", "", None], X.opaque_words) == [["a1b2c3d4e5"], [], None]


def test_diff_noise(spark):
    hunks = [("@@ -1 +1 @@\n-a b\n+a  b", "x.py"), ("@@ -1 +1 @@\n-a\n+b", "x.py"), ("-a\n+b", "web/yarn.lock"), (None, "x.py")]
    df = spark.createDataFrame([(i, *h) for i, h in enumerate(hunks)], "i int, hunk string, path string")
    out = df.select("i", X.diff_noise(F.col("hunk"), F.col("path")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in out] == ["whitespace", None, "lockfile", None]
