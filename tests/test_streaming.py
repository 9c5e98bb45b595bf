from datetime import datetime, timedelta

from lodestream.operators import rollup
from lodestream.streaming import windows


def test_streams_agree_with_batches(spark, small, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    src = f"{small}/events.parquet"
    batch = spark.read.parquet(src)
    batch.selectExpr("*", "cast(ts AS timestamp) AS at").drop("ts").write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), rows.schema)
    got = windows.to_table(windows.tumbling(stream, "at", ["event_type"], "value"), "tumbling", str(tmp_path / "c1"))
    want = rollup.rollup(rows, "at", "hour", "value", ["event_type"])
    assert sorted((r.started, r.event_type, r.n, r.total) for r in got.collect()) == sorted((r.bucket, r.event_type, r.n, r.total) for r in want.collect())
    got = windows.to_table(windows.sessions(stream, "at", "user_id", "6 hours"), "sessions", str(tmp_path / "c2"))
    want = rollup.sessions(rows, "user_id", "at", "6 hours")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_token_bucket_and_drift(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", at + timedelta(seconds=s), h) for s, h in ((0, "x"), (1, "x"), (2, "y"), (62, "y"))] + [("b", at, "x")], "k string, at timestamp, h string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), rows.schema)
    got = windows.to_table(windows.token_bucket(stream, "k", "at", 1, 2), "bucket", str(tmp_path / "c1"), "append").collect()
    assert sorted((r.k, r["at"].second + 60 * r["at"].minute, r.allowed) for r in got) == [("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 62, True), ("b", 0, True)]
    got = windows.to_table(windows.drift(stream, "k", "at", "h"), "drift", str(tmp_path / "c2"), "append").collect()
    assert sorted((r.k, r.changed) for r in got) == [("a", False), ("a", False), ("a", False), ("a", True), ("b", False)]
