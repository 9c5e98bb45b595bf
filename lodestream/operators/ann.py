"""Approximate nearest neighbours by an inverted-file index that outlives the session.

Centres are fitted on a bounded sample; every vector, scaled to length 1, is filed under its nearest centre. A query
looks into the lists of the centres nearest to it, and what it finds there is ranked by exact cosine. Lists are cut into
parts of bounded size, so that a list which holds a large share of all vectors is worked on by many tasks; a query
meets all parts of its lists.

How many lists a query looks into sets the recall; all of them give the exact result. Where it isn't asked for, it is
the least number that finds the share RECALL of true neighbours among the sampled vectors, told when the index is built.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.session import shared_dir

#: Vectors that centres are fitted on at most, and centres at most: both bound what the driver holds.
SAMPLE, CENTRES = 20_000, 1_024
#: The share of neighbours to find, and how many sampled vectors and neighbours of each it is measured on.
RECALL, MEASURED, NEIGHBOURS = 0.97, 400, 10
#: Vectors in a part of a list, about; queries that are multiplied with a part at once.
PART, BLOCK = 20_000, 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows of length 0 stay."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def fitted(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k centres of unit vectors: spread by squared distance, then moved to the means of what is nearest to them."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.integers(len(sample), size=1)]
    far = 1 - sample @ centres[0]
    while len(centres) < k:
        weight = np.maximum(far, 0)
        pick = rng.choice(len(sample), p=weight / weight.sum()) if weight.sum() > 0 else rng.integers(len(sample))
        centres = np.vstack([centres, sample[pick]])
        far = np.minimum(far, 1 - sample @ centres[-1])
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        filled = np.bincount(own, minlength=k) > 0
        centres[filled] = unit(sums[filled])
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray) -> int:
    """How many lists some sampled vectors must look into to find RECALL of their nearest neighbours in the sample."""
    some = sample[:: max(1, len(sample) // MEASURED)]
    own = (sample @ centres.T).argmax(1)
    rank = np.argsort(np.argsort(-(some @ centres.T), axis=1, kind="stable"), axis=1)
    near = np.argsort(-(some @ sample.T), axis=1, kind="stable")[:, 1 : NEIGHBOURS + 1]
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)]) + 1 if len(needed) else 1


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors of one width as rows; null ones and those of another width are zero."""
    rows = column.to_pylist()
    return np.array([r if r is not None and len(r) == width and None not in r else [0.0] * width for r in rows], np.float64).reshape(len(rows), width)


class VectorIndex:
    """An index at `path`: centres, and vectors in parts of lists, partitioned by list. `open` finds it in later sessions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # CENTRES at most
        self.centres, self.probes, self.id_type = np.array([r.centre for r in rows], np.float64), rows[0].probes, rows[0].id_type

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str, vector_col: str, path: str | None = None, centres: int | None = None) -> VectorIndex:
        """File every vector of rows (id, vector) that isn't null; vectors of length 0 are filed too, under the first centre."""
        spark = vectors.sparkSession
        path = path or f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
        known = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        n = known.count()
        # the sample covers all rows: a share of all hashes, which is taken again below the bound
        share = min(1.0, 1.5 * SAMPLE / max(1, n))
        some = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(F.xxhash64("id")).limit(SAMPLE)
        drawn = [r.vector for r in some.select("vector").collect()]
        width = len(drawn[0]) if drawn else 1
        sample = unit(np.array([v for v in drawn if len(v) == width], np.float64).reshape(-1, width))
        k = min(CENTRES, centres or max(1, int(n**0.5)), max(1, len(sample)))
        middle = fitted(sample, k) if len(sample) else np.zeros((1, width))
        probes, kind = probes_needed(sample, middle), known.schema["id"].dataType.simpleString()
        spark.createDataFrame([(i, c.tolist(), probes, kind) for i, c in enumerate(middle)], "list int, centre array<double>, probes int, id_type string").coalesce(1).write.parquet(f"{path}/centres")
        index = cls(spark, path)
        index.add(known, "id", "vector")
        return index

    def add(self, vectors: DataFrame, id_col: str, vector_col: str) -> None:
        """File more vectors; lists that grow get more parts."""
        filed = self._nearest_lists(vectors, id_col, vector_col, 1).withColumnRenamed("lists", "list").withColumn("list", F.col("list")[0])
        sizes = filed.groupBy("list").agg(F.count("*").alias("n"))
        parts = sizes.select("list", F.expr(f"1 + n div {PART}").alias("parts"))  # one row a list, CENTRES at most
        dealt = filed.join(F.broadcast(parts), "list").withColumn("part", F.concat(F.lit(uuid.uuid4().hex[:8]), F.lit("-"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("string")))
        dealt.select("id", "vector", "part", "list").repartition("list", "part").write.partitionBy("list").mode("append").parquet(f"{self.path}/lists")

    def _nearest_lists(self, vectors: DataFrame, id_col: str, vector_col: str, n: int) -> DataFrame:
        """id, vector (scaled to length 1), lists: the n centres nearest to each."""
        centres = self.centres
        n = min(n, len(centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = unit(_matrix(batch.column("vector"), centres.shape[1]))
                near = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(rows)), pa.array(list(near))], names=["id", "vector", "lists"])

        slim = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, vector array<double>, lists array<int>")

    def nearest(self, queries: DataFrame, id_col: str, vector_col: str, k: int, probes: int | None = None) -> DataFrame:
        """query, id, similarity, rank: the k most similar of the vectors in the lists that each query looks into.

        A query doesn't find its own id. Similarities are rounded to 6 digits, ties go to the smaller id.
        """
        read = lambda: self.spark.read.schema(f"id {self.id_type}, vector array<double>, part string, list int").parquet(f"{self.path}/lists")
        lists, parts = read(), read().select("list", "part").distinct()
        asked = self._nearest_lists(queries.where(F.col(vector_col).isNotNull()), id_col, vector_col, probes or self.probes)
        asked = asked.select(F.col("id").alias("query"), F.col("vector").alias("q"), F.explode("lists").alias("list")).join(parts, "list")
        kind = asked.schema["query"].dataType.simpleString()
        width = self.centres.shape[1]

        def best(held: pa.Table, wanted: pa.Table) -> pa.Table:
            ids = held.column("id").to_pylist()
            order = np.array(sorted(range(len(ids)), key=ids.__getitem__), int)
            rows = _matrix(held.column("vector"), width)[order]
            ids = [ids[j] for j in order]
            names, out = wanted.column("query").to_pylist(), ([], [], [])
            asked_rows = _matrix(wanted.column("q"), width)
            for at in range(0, len(names) if ids else 0, BLOCK):
                scores = np.round(asked_rows[at : at + BLOCK] @ rows.T, 6)
                for name, row in zip(names[at : at + BLOCK], scores):
                    top = np.argsort(-row, kind="stable")[: k + 1]
                    found = [j for j in top.tolist() if ids[j] != name][:k]
                    out[0].extend([name] * len(found))
                    out[1].extend(ids[j] for j in found)
                    out[2].extend(row[found].tolist())
            return pa.table({"query": pa.array(out[0], wanted.schema.field("query").type), "id": pa.array(out[1], held.schema.field("id").type), "similarity": pa.array(out[2], pa.float64())})

        found = lists.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInArrow(best, f"query {kind}, id {lists.schema['id'].dataType.simpleString()}, similarity double")
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)
