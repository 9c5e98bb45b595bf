"""From raw documents to token ids: each stage works on all that the stage before it kept.

Language ID (documents that it rejects go), exact dedup, near dedup (one document of each group stays), mixing of
sources (a row for each epoch that takes from a document, in training order) and BPE encoding with decoding.

The training order travels as the order of rows in the mixed table's files, which are range-sorted; the last stage
reads it off file and row numbers and gives each row its `position`, from 0. It encodes each distinct text once, and
its rows carry position and token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, exact, langid, minhash, mixing
from lodestream.session import ship_package, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return langid.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship_package(spark)
    # repeated epochs of a document are one text to encode
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    rows = mixing.positions(docs).withColumn("key", F.sha2(text.cast("binary"), 256))
    first = rows.groupBy("key").agg(F.min("position").alias("position")).select(F.bitwise_not("position").alias("first"))
    once = rows.join(first.hint("merge"), F.bitwise_not("position") == F.col("first"), "left_semi").select("key", "text")
    tokens = bpe.encode(once, public_tokenizers.path("byte_bpe_50k.json"), id_col="key", with_ids=True).withColumnRenamed("id", "key")
    return rows.select("key", "doc_id", "position").join(tokens.hint("merge"), "key").drop("key")


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: Language models and tokens have no SQL form; tests/llm/test_pipeline.py holds each stage's result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
