"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for two primes, the polynomial hash of every prefix. They answer the equality of any two
spans in constant time, and bisection over them finds longest common extensions (`PrefixHashes`).

* Likeness of two texts (`shared`): the longest common prefix and suffix, by one extension each way, and between them
  every block of BLOCK code points of the one text that occurs anywhere in the other, extended either way as far as
  the texts agree. What is covered, divided by the longer length, is the likeness; it is 1 for equal texts only.
* A fingerprint is a bounded extract of the arrays for keeping and exchange: length, hash of the whole, and hashes of
  prefixes and suffixes at up to 2 * GRID places each. Places are multiples of a power of two that grows with the
  length, so that the places of two texts of different length nest. `likeness` compares two of them where the texts
  are no longer at hand: it bisects over the common places for the longest common prefix and suffix, and is never more
  than what those two cover.

The next document of each one is found by one range partition of the texts by id: split points are fixed first, each
range's first document is copied to the range before it, and each range is then read in order.

Defined results
* null texts count as empty; the likeness of two empty texts is 1, of an empty and another 0.
* null ids stand before all others; rows that repeat an id stand in the order of their texts' hashes, in one range.
* the document after the last is the first; a single document is its own next. An empty table gives an empty result.
* other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Two primes below 2^31 with a base each: sums of up to 2^32 products of residues fit 64 bits.
PRIMES = ((2147483647, 1_103_515_245), (2147483629, 1_664_525_011))
#: A fingerprint has from GRID to 2 * GRID places from either end.
GRID = 16
#: Code points of a block that is looked for between common prefix and suffix.
BLOCK = 24

_POWERS: list[list[np.ndarray]] = []


def powers(n: int) -> list[list[np.ndarray]]:
    """For each prime its base's powers, and the inverse base's, up to n; kept and doubled when needed."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        size = 1 << max(10, n.bit_length())
        _POWERS.clear()
        for p, base in PRIMES:
            both = []
            for b in (base % p, pow(base, -1, p)):
                x = np.ones(1, np.uint64)
                while len(x) < size:
                    x = np.concatenate([x, x * np.uint64(pow(b, len(x), p)) % np.uint64(p)])
                both.append(x)
            _POWERS.append(both)
    return _POWERS


class PrefixHashes:
    """Prefix hashes of a sequence of code points; `start` may give those of a prefix of it already."""

    def __init__(self, codes: np.ndarray, start: PrefixHashes | None = None, upto: int = 0):
        self.n = len(codes)
        self.sums = []
        for k, ((p, _), (power, _)) in enumerate(zip(PRIMES, powers(self.n))):
            terms = (codes[upto:].astype(np.uint64) + np.uint64(1)) * power[upto : self.n] % np.uint64(p)
            head = start.sums[k][: upto + 1] if start else np.zeros(1, np.uint64)
            self.sums.append(np.concatenate([head, (np.cumsum(terms) + head[-1]) % np.uint64(p)]))

    def span(self, at: np.ndarray | int, to: np.ndarray | int) -> np.ndarray:
        """62-bit hashes of spans [at, to), comparable between places and texts."""
        return self.part(0, at, to) << np.uint64(31) | self.part(1, at, to)

    def part(self, k: int, at: np.ndarray | int, to: np.ndarray | int) -> np.ndarray:
        """Of the k-th prime, 31 bits."""
        p, s, inverse = np.uint64(PRIMES[k][0]), self.sums[k], powers(self.n)[k][1]
        return (s[to] + p - s[at]) % p * inverse[at] % p

    def same(self, other: PrefixHashes, at: int, there: int, length: int) -> bool:
        """Equality of two spans; single places are read as Python's integers, which are faster than arrays of one."""
        for (p, _), (_, inverse), s, t in zip(PRIMES, powers(max(self.n, other.n)), self.sums, other.sums):
            if (s.item(at + length) - s.item(at)) * inverse.item(at) % p != (t.item(there + length) - t.item(there)) * inverse.item(there) % p:
                return False
        return True

    def extension(self, other: PrefixHashes, at: int = 0, there: int = 0) -> int:
        """Length of the longest common extension from at and there on, by bisection."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(other, at, there, middle) else (low, middle - 1)
        return low


    def extension_back(self, other: PrefixHashes, to: int, there: int, most: int) -> int:
        """Length, at most `most`, of the longest common extension that ends before `to` and `there`."""
        low, high = 0, min(to, there, most)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(other, to - middle, there - middle, middle) else (low, middle - 1)
        return low


def shared(a: PrefixHashes, b: PrefixHashes, block: int = BLOCK) -> float:
    """What the common prefix, the common suffix and common passages between them cover of the longer text."""
    if a.n == b.n and a.same(b, 0, 0, a.n):
        return 1.0
    prefix = a.extension(b)
    suffix = a.extension_back(b, a.n, b.n, min(a.n, b.n) - prefix)
    covered = prefix + suffix
    end, last = a.n - suffix, b.n - block  # blocks of a lie between prefix and suffix, those of b anywhere
    at = np.arange(prefix, end - block + 1, block)
    if len(at) and last >= 0:
        # half of the hash finds where b may hold a block, the whole of it decides
        own, there = a.span(at, at + block), np.arange(last + 1)
        half, names = np.unique(own >> np.uint64(31)), b.part(0, there, there + block)
        near = there[half[np.minimum(np.searchsorted(half, names), len(half) - 1)] == names]
        names = b.span(near, near + block)
        order = np.argsort(names, kind="stable")
        names, near = np.append(names[order], np.uint64(1 << 63)), np.append(near[order], 0)  # the last is no hash
        place = np.searchsorted(names[:-1], own)
        free = prefix
        for k in np.flatnonzero(names[place] == own).tolist():
            i, j = int(at[k]), int(near[place[k]])
            if i < free:
                continue
            back = a.extension_back(b, i, j, i - free)
            ahead = min(a.extension(b, i, j), end - i)
            covered += back + ahead
            free = i + ahead
    return min(covered, a.n, b.n) / max(a.n, b.n)


def step(n: int) -> int:
    """The distance of a fingerprint's places: the power of two that gives GRID to 2 * GRID of them."""
    return 1 << max(0, (n // (2 * GRID)).bit_length())


def fingerprint(hashes: PrefixHashes) -> str:
    """length:whole:prefix hashes:suffix hashes, in hexadecimal."""
    n = hashes.n
    at = np.arange(step(n), n + 1, step(n))
    parts = (np.atleast_1d(hashes.span(0, n)), hashes.span(np.zeros(len(at), int), at), hashes.span(n - at, np.full(len(at), n)))
    return f"{n:x}:" + ":".join("".join(f"{x:016x}" for x in part.tolist()) for part in parts)


def likeness(a: str, b: str) -> float:
    """What longest common prefix and suffix cover of the longer text, as far as two fingerprints tell; 1 if equal."""
    if a == b:
        return 1.0
    (n, _, *ends), (m, _, *others) = a.split(":"), b.split(":")
    n, m = int(n, 16), int(m, 16)
    wide = max(step(n), step(m))
    covered = 0
    for x, y in zip(ends, others):
        x = [x[i : i + 16] for i in range(0, len(x), 16)][wide // step(n) - 1 :: wide // step(n)]
        y = [y[i : i + 16] for i in range(0, len(y), 16)][wide // step(m) - 1 :: wide // step(m)]
        low, high = 0, min(len(x), len(y))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if x[middle - 1] == y[middle - 1] else (low, middle - 1)
        covered += low * wide
    return min(covered, min(n, m)) / max(n, m, 1) if (n, m) != (0, 0) else 1.0


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def in_id_order(docs: DataFrame) -> DataFrame:
    """Rows (id, text) as (slot, role, id, text), each slot whole within a partition and in ascending order of id.

    A slot's last row, with role 1, is a copy of the next slot's first one; if that one is repeated, its copies are
    equal and the first of them tells all. The driver holds, for four slots a shuffle partition, a split point and a
    first row's id and hash; they go to the tasks as one broadcast of that size, and are looked up by bisection over
    the ids alone. Texts are shuffled once.
    """
    spark = docs.sparkSession
    slots = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    splits = docs.agg(F.percentile_approx("id", [k / slots for k in range(1, slots)], 100 * slots)).first()[0]
    cut = spark.sparkContext.broadcast(np.array(sorted(set(splits or [])), np.int64))

    def slots_of(id_: pa.Array) -> np.ndarray:
        return np.where(np.asarray(id_.is_valid()), np.searchsorted(cut.value, np.asarray(id_.fill_null(0)), side="left"), 0)

    @F.arrow_udf("int")
    def slot_of(id_: pa.Array) -> pa.Array:
        return pa.array(slots_of(id_), pa.int32())

    first = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "hash")).alias("first")
    heads = sorted((r["slot"], r["first"]) for r in docs.select("id", "hash").withColumn("slot", slot_of("id")).groupBy("slot").agg(first).collect())
    rows = [(None, 0, 0)] * (heads[-1][0] + 1 if heads else 0)
    for k, (slot, head) in enumerate(heads):
        rows[slot] = (head["id"], head["hash"], heads[k - 1][0])
    lead = spark.sparkContext.broadcast(rows)

    @F.arrow_udf("array<struct<slot:int,role:int>>")
    def places(id_: pa.Array, hash_: pa.Array) -> pa.Array:
        """Its own slot with role 0; for a slot's first row also the slot before with role 1."""
        out = []
        for doc, h, slot in zip(id_.to_pylist(), hash_.to_pylist(), slots_of(id_).tolist()):
            own, head, before = lead.value[slot]
            out.append([{"slot": slot, "role": 0}] + [{"slot": before, "role": 1}] * (doc == own and h == head))
        return pa.array(out, pa.list_(pa.struct([("slot", pa.int32()), ("role", pa.int32())])))

    placed = docs.select(F.explode(places("id", "hash")).alias("p"), "id", "hash", "text").select("p.slot", "p.role", "id", "hash", "text")
    return placed.repartition("slot").sortWithinPartitions("slot", "role", F.col("id").asc_nulls_first(), "hash").drop("hash")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last quarter (rounded down) replaced by as many first characters of the next document.
    """

    def described(doc: int | None, text: str, hashes: PrefixHashes, own: str, after: str, its: PrefixHashes) -> tuple:
        n = hashes.n
        take = n // 4
        codes, more = codes_of(text), codes_of(after[:take])
        edited = PrefixHashes(np.concatenate([codes[: n - take], more]), hashes, n - take)
        digest = hashlib.sha256((text[: n - take] + after[:take]).encode()).hexdigest()
        return doc, n, digest, own, fingerprint(edited), shared(hashes, edited), shared(hashes, its)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = []
            for slot, role, doc, value in zip(batch.column("slot").to_pylist(), batch.column("role").to_pylist(), batch.column("id").to_pylist(), batch.column("text")):
                if held and held[:2] == (slot, 1):
                    continue  # one more copy of the next slot's first row
                text = value.as_py()
                hashes = PrefixHashes(codes_of(text))
                if held and held[0] == slot:
                    rows.append(described(*held[2:], text, hashes))
                held = (slot, role, doc, text, hashes, fingerprint(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_id_order(slim).select("slot", "role", "id", "text").mapInArrow(run, schema)
