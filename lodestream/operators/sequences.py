"""Measures of whole texts that need a loop of their own: longest common subsequences and deflated sizes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table held as the bits of one integer."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, keys: list[str], candidate: str, reference: str, digits: int = 6) -> DataFrame:
    """keys and rouge_l, the F1 of the longest common subsequence of words; 0 where a side is null or without words.

    Row by row, no shuffle; a row needs memory in proportion to its own texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, r in zip(batch.column("__c").to_pylist(), batch.column("__r").to_pylist()):
                c, r = (c or "").encode().lower().split(), (r or "").encode().lower().split()
                out.append(round(2 * common_subsequence(c, r) / (len(c) + len(r)), digits) if c and r else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.float64())], names=[*keys, "rouge_l"])

    slim = pairs.select(*keys, F.col(candidate).alias("__c"), F.col(reference).alias("__r"))
    kinds = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys)
    return slim.mapInArrow(run, f"{kinds}, rouge_l double")


def deflated(rows: DataFrame, key: str, text: str, level: int = 1) -> DataFrame:
    """key, size and packed: bytes of each whole text in UTF-8, before and after deflating; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("__text").to_pylist()]
            sizes = [pa.array(map(f, texts), pa.int64()) for f in (len, lambda t: len(zlib.compress(t, level)))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *sizes], names=[key, "size", "packed"])

    slim = rows.select(key, F.col(text).alias("__text"))
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, size long, packed long")
