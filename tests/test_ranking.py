import math

from pyspark.sql import functions as F

from lodestream.operators import ranking

NAN = float("nan")
ROWS = [(i, [((i * 7 + d * 13) % 11) - 5.0 for d in range(4)]) for i in range(40)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(40, 60)]
ROWS += [(60, [0.0] * 4), (61, [1.0, 2.0]), (62, None), (63, [1e200] * 4), (64, [1e-170] * 4), (65, [1.0, None, 0.0, 0.0]), (66, [1.0, NAN, 0.0, 0.0]), (None, [1.0] * 4), (67, [])]


def test_nearest_meets_in_blocks_and_equals_cosine_over_all_pairs(spark, capsys):
    df = spark.createDataFrame(ROWS, "id int, v array<double>")
    asked = df.where("id % 5 = 0 OR id >= 60")
    pairs = df.toDF("id", "v").join(asked.toDF("query", "q"), F.col("id") != F.col("query"))
    scored = pairs.select("query", "id", F.round(ranking.cosine(F.col("v"), F.col("q")), 6).alias("s")).where("s >= -0.5").collect()
    number = lambda x: math.inf if math.isnan(x) else x
    want = set()
    for query in {r.query for r in scored}:
        best = sorted((-number(r.s), r.id) for r in scored if r.query == query)[:3]
        want |= {(query, i, -s, k) for k, (s, i) in enumerate(best, 1)}
    for block in (7, 1000):
        got = ranking.nearest(df, asked, "id", "v", 3, -0.5, block=block)
        assert {(r.query, r.id, number(r.similarity), r.rank) for r in got.collect()} == want
    got.explain()
    assert "NestedLoop" not in capsys.readouterr().out  # pairs aren't rows
