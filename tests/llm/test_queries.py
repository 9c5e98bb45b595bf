"""The queries op1 to op10 beside their SQL, or their operator's tests' terms, on the smallest tables."""

import duckdb
import pytest

from lodestream.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_as_sql(spark, small, name):
    from lodestream.session import ship_package

    ship_package(spark)
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in columns) for r in got.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_returns_every_document(spark, small, name):
    from lodestream.session import ship_package

    ship_package(spark)
    out = queries.queries()[name](spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    assert out.count() == docs and out.select("doc_id").distinct().count() == docs
