"""Operators over JSON held in text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_paths(rows: DataFrame, key: str, text: str, depth: int = 8) -> DataFrame:
    """key, path, value for every leaf of the JSON in `text`, down to `depth`; what lies deeper stays whole.

    Each level opens objects and arrays in place and leaves scalars as they are, so that the source is read once and
    nothing is shuffled. Texts that are no JSON give no rows; empty objects and arrays are leaves.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("__id"), F.lit("$").alias("path"), F.try_parse_json(text).alias("node")).where("node IS NOT NULL")
    for _ in range(depth):
        opened = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("node").outer()))
        step = F.coalesce(F.concat(F.lit("."), F.col("key")), F.concat(F.lit("["), F.col("pos"), F.lit("]")), F.lit(""))
        level = opened.select("__id", F.concat("path", step).alias("path"), F.coalesce("value", "node").alias("node"))
    return level.select(F.col("__id").alias(key), "path", F.expr("variant_get(node, '$', 'string')").alias("value"))


def array_kinds(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind of the JSON arrays in `text`: empty, dicts, strings, numbers, bools, nested, or mixed.

    An array is of a kind if all its items are; nulls alone are mixed. Texts that are no JSON array have no row.
    """
    parsed = rows.select(F.col(key).alias("__id"), F.try_parse_json(text).alias("node")).where("schema_of_variant(node) like 'ARRAY%'")
    items = parsed.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("node").outer()))
    own = F.expr("schema_of_variant(value)")
    kind = (
        F.when(own.startswith("OBJECT"), "dicts").when(own.startswith("ARRAY"), "nested").when(own == "STRING", "strings").when(own == "BOOLEAN", "bools")
        .when(own == "VOID", "mixed").when(own.isNotNull(), "numbers")
    )
    found = items.groupBy("__id").agg(F.min(kind).alias("least"), F.max(kind).alias("most"))
    whole = F.when(F.col("least").isNull(), "empty").when(F.col("least") == F.col("most"), F.col("least")).otherwise("mixed")
    return found.select(F.col("__id").alias(key), whole.alias("kind"))
