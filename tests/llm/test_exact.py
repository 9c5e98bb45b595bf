import re

import pytest

from lodestream.llm import exact


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for members in groups.values():
        keep = min(members, key=lambda m: m[:3])[3]
        out += [(i, keep, len(members), i == keep) for *_, i in members]
    return sorted(out, key=str)


def test_resolves_as_brute_force(odd, odd_rows):
    got = exact.resolve_duplicates(odd).select("id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(odd_rows)


def test_drop_keeps_columns_and_keepers(odd, odd_rows):
    out = exact.drop_duplicates(odd)
    assert out.columns == odd.columns
    want = sorted((i for i, _, _, kept in brute(odd_rows) if kept), key=str)
    assert sorted((r.doc_id for r in out.collect()), key=str) == want


def test_index_persists_and_drops_what_it_knows(spark, tmp_path):
    index = exact.DigestIndex(spark, "digests_kept_for_later", f"file://{tmp_path}/index", buckets=3)
    first = spark.createDataFrame([(1, "a b"), (2, "ab "), (3, "c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact.drop_duplicates(first, index=index).collect()) == [1, 3]
    assert index.rows().count() == 2
    spark.sql("DROP TABLE digests_kept_for_later")
    again = exact.DigestIndex(spark, "digests_kept_for_later", f"file://{tmp_path}/index", buckets=3)
    second = spark.createDataFrame([(4, "a  b  longer?"), (5, "a   b"), (6, "d"), (7, "d ")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact.drop_duplicates(second, index=again).collect()) == [4, 7]
    assert again.rows().count() == 4


def test_an_index_keeps_its_buckets_under_other_settings(spark, tmp_path):
    at, rows = f"file://{tmp_path}/index", [(i, f"text {i % 150}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact.drop_duplicates(docs, index=exact.DigestIndex(spark, "digests_under_settings", at, buckets=3)).count()
    exact.DigestIndex(spark, "digests_under_settings", at).drop()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        again = exact.DigestIndex(spark, "digests_under_settings", at)
        assert again.buckets == 3 and exact.drop_duplicates(docs, index=again).count() == 0
        assert exact.DigestIndex(spark, "digests_under_settings").buckets == 3  # by the catalog
        with pytest.raises(ValueError):
            exact.DigestIndex(spark, "digests_under_settings", at, buckets=5)
        again.drop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_resolve_on_a_filled_index_decides_over_all_batches(spark):
    index = exact.DigestIndex(spark, buckets=3)
    first = [(1, "a b"), (2, "c"), (3, "ab"), (4, "alone")]
    second = [(5, "a  b"), (6, "c"), (7, "new"), (8, "n e w")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert brute(first) == sorted(map(tuple, exact.resolve_duplicates(frame(first), index=index).select("id", "keep_id", "group_size", "kept").collect()), key=str)
    got = exact.resolve_duplicates(frame(second), index=index).select("id", "keep_id", "group_size", "kept").collect()
    want = [r for r in brute(first + second) if r[0] > 4]
    assert sorted(map(tuple, got), key=str) == want == [(5, 5, 3, True), (6, 2, 2, False), (7, 8, 2, False), (8, 8, 2, True)]
    index.drop()


def test_batches_do_not_change_the_result_and_leave_no_table(spark, odd, odd_rows):
    before = {t.name for t in spark.catalog.listTables()}
    for batches in (2, 3):
        got = exact.resolve_duplicates(odd, batches=batches).select("id", "keep_id", "group_size", "kept").collect()
        assert sorted(map(tuple, got), key=str) == brute(odd_rows)
    assert exact.drop_duplicates(odd).count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before


def test_index_side_of_the_join_is_not_shuffled(spark):
    index = exact.DigestIndex(spark, buckets=3)
    found = exact.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    index.ingest(found)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        batch = found.groupBy("digest").count().repartition(3, "digest")
        plan = batch.join(index.rows().select("digest").hint("merge"), "digest", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        index.drop()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 2


def test_empty_table(none):
    assert exact.resolve_duplicates(none).count() == 0
    assert exact.drop_duplicates(none).count() == 0
