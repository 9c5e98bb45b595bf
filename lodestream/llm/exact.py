"""Exact dedup against a persistent digest index, in DataFrame operations only.

The index is a pair of tables bucketed and sorted by digest: `first` has one row for each distinct normalised text,
appended when a batch first brings it; `again` has one row for each later batch that brought the text once more, so
that sizes and keepers over all batches can be told without rewriting anything. New data is reduced to one row a
digest, split by a sort-merge join with the index (which is read in its buckets and isn't shuffled) into what is new
and what is known, and appended. At each size the only shuffles are the narrow digest rows of the new data.

The number of buckets is a property of the index, kept beside it: a session with other shuffle settings adopts it.

Defined results
* null texts count as empty; empty texts, and texts of white space alone, are equal to each other.
* of equal texts the one with the most code points in its original text is the keeper, of those the one with the
  smallest id; null ids come after all others. `resolve_duplicates` decides over all that the index has seen;
  `drop_duplicates` lets no text stay that an earlier batch held, whatever its length. Rows that repeat an id and text
  are decided alike: the row whose id is the group's keep_id is kept, so repeated rows of the keeper are all kept.
* an empty table gives an empty result and an empty index.
* columns besides id and text are carried by `drop_duplicates` and never looked at.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.session import discard, written

#: The characters of [\x20\x09-\x0D].
WHITE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """Text without white space; null counts as empty. Chained byte replacements are the fastest form in the JVM."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (hex SHA-256 of the normalised text) and n, the code points of the original."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n"),
    )


class DigestIndex:
    """A digest index kept as two bucketed, sorted tables, `<name>` and `<name>_again`.

    With `path` they live there and `DigestIndex(spark, name, path)` in a later session finds their rows again;
    without it, they live in the warehouse. `buckets` counts for a new index; a number that differs from that of an
    existing one is refused.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path
        kept = self._kept_buckets()
        if kept and buckets and kept != buckets:
            raise ValueError(f"the index {self.name} has {kept} buckets, not {buckets}")
        self.buckets = kept or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for table, at in self._tables():
            if not spark.catalog.tableExists(table):
                spark.sql(
                    f"CREATE TABLE {table} (digest STRING, keep_id BIGINT, keep_n BIGINT, group_size BIGINT) USING parquet "
                    f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS" + (f" LOCATION '{at}'" if at else "")
                )
        if path and not kept:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/_buckets")

    def _tables(self) -> list[tuple[str, str | None]]:
        return [(self.name, self.path and f"{self.path}/first"), (f"{self.name}_again", self.path and f"{self.path}/again")]

    def _kept_buckets(self) -> int | None:
        """How many buckets an existing index has: by the catalog, or by the note beside its files."""
        if self.spark.catalog.tableExists(self.name):
            rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").where("col_name = 'Num Buckets'").collect()
            if not rows:
                raise ValueError(f"{self.name} is a table without buckets")
            return int(rows[0].data_type)
        if not self.path:
            return None
        note = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_buckets")
        if not note.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(note):
            return None
        return self.spark.read.parquet(note.toString()).first().buckets

    def rows(self) -> DataFrame:
        """One row a text: digest, and keep_id, keep_n, group_size in the batch that brought it first."""
        return self.spark.table(self.name)

    def groups(self) -> DataFrame:
        """digest, keep_id, group_size over all batches, of the texts that occurred at least twice."""
        again = self.spark.table(f"{self.name}_again").groupBy("digest").agg(_best("keep_n", "keep_id").alias("later"), F.sum("group_size").alias("more"))
        best = F.greatest(F.struct(F.col("keep_n").alias("n"), F.bitwise_not("keep_id").alias("back")), "later")
        size = (F.col("group_size") + F.coalesce("more", F.lit(0))).cast("long")
        every = self.rows().join(again.hint("merge"), "digest", "left").select("digest", best.alias("best"), size.alias("group_size"))
        return every.where("group_size > 1").select("digest", F.bitwise_not(F.col("best.back")).alias("keep_id"), "group_size")

    def ingest(self, found: DataFrame) -> DataFrame:
        """Append the digests of `found` (from `digests`); those that the index lacked are returned.

        Partial aggregation reduces copies before the shuffle, so a text that a third of all rows share costs one row
        a task. The batch is hashed to as many partitions as the index has buckets, which is how the sort-merge join
        finds both sides in place.
        """
        batch = (
            found.groupBy("digest")
            .agg(_best("n", "id").alias("best"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.bitwise_not(F.col("best.back")).alias("keep_id"), F.col("best.n").alias("keep_n"), "group_size")
            .repartition(self.buckets, "digest")
        )
        known = self.rows().select("digest", F.lit(True).alias("known")).hint("merge")
        batch = written(batch.join(known, "digest", "left"), "batch-digests")
        for (table, at), part in zip(self._tables(), ("known IS NULL", "known")):
            to = batch.where(part).drop("known").repartition(self.buckets, "digest").write.mode("append").format("parquet")
            to.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table, **({"path": at} if at else {}))
        new = written(batch.where("known IS NULL").drop("known"), "new-digests")
        discard(batch)
        return new

    def drop(self) -> None:
        """Forget the index; one that lives in the warehouse is deleted, the files of one with a path stay."""
        for table, _ in self._tables():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def _best(n: str, id_col: str) -> Column:
    """The most code points, then the least id: ~id orders ids backwards without overflow, a null id is the least of all."""
    return F.max(F.struct(F.col(n).alias("n"), F.bitwise_not(F.col(id_col)).alias("back")))


def resolve(found: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row of `found` with keep_id, group_size and kept, from rows (digest, keep_id, group_size) of all texts that occur twice.

    Digests that occur once need no partner. Both sides are shuffled by the planner, which lets adaptive execution
    split the partition of a text that very many rows share.
    """
    size = F.coalesce(F.col("group_size"), F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    out = found.join(groups.hint("merge"), "digest", "left").select("id", keep.alias("keep_id"), size.alias("group_size"), "digest")
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def resolve_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """One row per document: id, keep_id, group_size, digest, kept, over these documents and all that `index` has seen.

    `batches` takes the documents into the index in so many parts, by a hash of their id, as if they had arrived so;
    the result is the same for any number. Without an index a new one is made, and dropped when it has answered.
    """
    own = index or DigestIndex(docs.sparkSession)
    found = written(digests(docs, id_col, text_col), "digests")
    part = F.pmod(F.xxhash64("id"), F.lit(batches))
    for k in range(batches):
        discard(own.ingest(found.where(part == k) if batches > 1 else found))
    groups = written(own.groups(), "groups")
    if index is None:
        own.drop()
    return resolve(found, groups)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns; what `index` held before is dropped whatever its length.

    The join keys are digest and id together, so that copies of one text spread over all tasks.
    """
    own = index or DigestIndex(docs.sparkSession)
    new = own.ingest(digests(docs, id_col, text_col))
    if index is None:
        own.drop()
    keepers = new.select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep")).hint("merge")
    same = (F.sha2(normalised(docs[text_col]).cast("binary"), 256) == F.col("__digest")) & docs[id_col].eqNullSafe(F.col("__keep"))
    return docs.join(keepers, same, "left_semi")
