"""Near-duplicate documents by min-max hashing, banding, exact confirmation and connected components.

* A document's set: the distinct shingles of `words` consecutive words (A-Z in lower case), or its whole sequence as
  one where it has fewer words.
* Each of `bands * rows / 2` hash functions gives two signature values, its minimum and its maximum over the set, so
  that half the evaluations of plain MinHash are needed; both agree between two sets with the sets' similarity.
* Documents with equal sets are one node from then on. Nodes that agree on a whole band share a bucket.
* Candidates are confirmed on full sets. First every node is held against one hub, the least node it shares a bucket
  with, and components are formed. Pairs within a component are never made, so a large group of copies costs one pair
  a document.
* Buckets that still hold several components are open. For each node in one, its shingles that any other open node
  has are counted; no intersection is larger than that count, which rules out heavily edited copies at once. What is
  left is held against a second hub, one that has few shingles of its own. The intersections with it bound those
  between any two nodes of the bucket; only pairs between components that pass this bound are confirmed. They are
  looked for between nodes whose sizes allow a link (classes of sizes, the same or the next one) and block by block,
  so that no task meets a whole bucket. No candidate link is lost.

Were bands independent, a pair at similarity 0.75 would be missed by 32 bands of 4 rows with a probability of 5e-6;
minimum and maximum of one function are nearly so on large sets. The README has the recall measured by brute force.
Sets are held as 64-bit names of their shingles: a link is decided wrongly only if two different shingles of one pair
share a name and the pair stands at the threshold.

Defined results
* null and empty texts have the empty set, are linked with nothing and are kept.
* rows that repeat an id are one node: their sets are all linked. A row with a null id has a null component and is kept.
* an empty table gives an empty result. Other columns are carried by `drop_near_duplicates` and never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.graph import components
from lodestream.session import discard, small_batches, written

#: Members of a hub that one task confirms, and of an open bucket that stand in one block.
SALT_ROWS, BLOCK_ROWS = 250, 1000
#: Words whose hashes a worker remembers at most.
MEMO = 200_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word; bytes.lower and bytes.split know ASCII only, which is the definition of words here."""
    words = text.encode().lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    width = min(words, len(w))
    by = _odd(words, 5)
    x = np.full(len(w) - width + 1, width, np.uint64)
    for j in range(width):
        x += w[j : len(w) - width + 1 + j] * by[j]
    return np.unique(mixed(x))


def signature(shingles: np.ndarray, evaluations: int, seed: int = 11) -> np.ndarray:
    """Minima, then maxima, of each hash function over a set that isn't empty."""
    a, b = _odd(evaluations, seed)[:, None], _odd(evaluations, seed + 1)[:, None]
    low, high = None, None
    for at in range(0, len(shingles), 2048):
        v = shingles[None, at : at + 2048] * a + b
        lo, hi = v.min(1), v.max(1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band; a band takes minima only or maxima only, of different functions."""
    x = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in values.reshape(bands, rows).T:
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + column)
    return x.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """id, n, digest of the set, bands (null for the empty set) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, keys = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(band_keys(signature(s, bands * rows // 2), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "digest", "bands"])

    return docs.mapInArrow(run, "id long, n long, digest binary, bands array<long>")


def packed_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, n and set, the names of the shingles in order, of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            packed = [s.astype("<u8").tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(len, sets), pa.int64()), pa.array(packed, pa.binary())], names=["node", "n", "set"])

    return docs.mapInArrow(run, "node long, n long, set binary")


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """hub, node, both (the intersection of their full sets), linked (100 * intersection >= percent * union).

    A hub's set goes to as many tasks as its members need; each task streams its members past it, holding one hub.
    """
    salts = F.ceil(F.col("members") / SALT_ROWS).cast("int")
    hubs = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("members")).withColumn("salts", salts)
    own = hubs.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    theirs = pairs.select(F.bitwise_not("hub").alias("key"), "hub", "node").join(hubs.select(F.bitwise_not("hub").alias("key"), "salts"), "key").select("hub", "node", salt.alias("salt"), F.lit(1).alias("role"))
    rows = own.union(theirs).join(sets, "node").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, against = None, []
        for batch in batches:
            out = []
            for h, node, salt, role, packed in zip(*(batch.column(c).to_pylist() for c in ("hub", "node", "salt", "role", "set"))):
                s = _unpacked(packed)
                if role == 0:
                    against = [*against, s] if hub == (h, salt) else [s]
                    hub = (h, salt)
                    continue
                both = [int(np.count_nonzero(x[np.minimum(np.searchsorted(x, s), len(x) - 1)] == s)) for x in against]
                out.append((h, node, max(both), any(100 * k >= percent * (len(x) + len(s) - k) for k, x in zip(both, against))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["hub", "node", "both", "linked"])

    return rows.select("hub", "node", "salt", "role", "set").mapInArrow(run, "hub long, node long, both long, linked boolean")


def shared_counts(sets: DataFrame, ranges: int) -> DataFrame:
    """node, shared: how many shingles of each set another node's set has too, of rows (node, set).

    A task settles chunks of its nodes: shingles that several nodes of the chunk have are counted there, and one entry
    without a node speaks for them elsewhere. The entries go packed to the owners of hash ranges, which count the rest.
    """

    def settle(names: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        name, node = np.concatenate(names), np.concatenate(nodes)
        order = np.argsort(name, kind="stable")
        name, node = name[order], node[order]
        starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        several = np.diff(np.append(starts, len(name))) > 1
        told, k = np.unique(node[np.repeat(several, np.diff(np.append(starts, len(name))))], return_counts=True)
        rows = [(int(i) % ranges, None, x.tobytes()) for i, x in enumerate(np.stack([told, k], 1).astype("<i8"))]
        name, node = name[starts], np.where(several, -1, node[starts])
        cuts = np.searchsorted(name, np.arange(1, ranges, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // ranges))
        rows += [(i, n.tobytes(), d.astype("<i8").tobytes()) for i, (n, d) in enumerate(zip(np.split(name, cuts), np.split(node, cuts))) if len(n)]
        for at in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 2000]), (pa.int32(), pa.binary(), pa.binary()))], names=["range", "names", "nodes"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, nodes, held = [], [], 0
        for batch in batches:
            for node, packed in zip(batch.column("node").to_pylist(), batch.column("set")):
                names.append(_unpacked(packed.as_py()))
                nodes.append(np.full(len(names[-1]), node, np.int64))
                held += len(names[-1])
                if held >= 1_000_000:
                    yield from settle(names, nodes)
                    names, nodes, held = [], [], 0
        if held:
            yield from settle(names, nodes)

    def own(table: pa.Table) -> pa.Table:
        told, names, nodes = [np.zeros((0, 2), np.int64)], [], []
        for n, d in zip(table.column("names").to_pylist(), table.column("nodes").to_pylist()):
            if n is None:
                told.append(np.frombuffer(d, "<i8").reshape(1, 2))
            else:
                names.append(np.frombuffer(n, "<u8"))
                nodes.append(np.frombuffer(d, "<i8"))
        if names:
            name, node = np.concatenate(names), np.concatenate(nodes)
            order = np.argsort(name, kind="stable")
            name, node = name[order], node[order]
            again = np.concatenate([[False], name[1:] == name[:-1]])
            again[:-1] |= again[1:]
            told.append(np.stack(np.unique(node[again & (node != -1)], return_counts=True), 1))
        found = np.concatenate(told)
        return pa.table({"node": pa.array(found[:, 0], pa.int64()), "shared": pa.array(found[:, 1], pa.int64())})

    packed = sets.select("node", "set").mapInArrow(gather, "range int, names binary, nodes binary")
    return packed.groupBy("range").applyInArrow(own, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))


def _could_link(percent: int) -> F.Column:
    """Whether the sets of x and y can be so similar at all.

    n: size; h: intersection with the bucket's hub; e: shingles outside the hub that other nodes have. What x and y
    have in common lies in the hub, at most the lesser h, or outside of it, at most the lesser e.
    """
    sizes = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    return sizes & ((100 + percent) * (F.least("hx", "hy") + F.least("ex", "ey")) >= percent * (F.col("nx") + F.col("ny")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """id, n_shingles, component_id, kept of every row of `docs`."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = written(signatures(slim, words, bands, rows), "signatures")
    usable = found.where(F.col("id").isNotNull() & (F.col("n") > 0))
    same = usable.groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "node")
    narrow = usable.select("id", "n", "digest").join(same, "digest", "left").select("id", "n", F.coalesce("node", "id").alias("node"))
    buckets = usable.join(same.select("digest", "node"), "digest", "left").where(F.coalesce("node", "id") == F.col("id")).select(F.col("id").alias("node"), "n", F.explode("bands").alias("band"))
    hubs = buckets.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select(F.bitwise_not("band").alias("key"), "hub")
    members = written(buckets.withColumn("key", F.bitwise_not("band")).join(hubs, "key").select("band", "node", "n", "hub"), "members")

    wanted = members.select("node").distinct()
    text_of = slim.where(F.col("id").isNotNull()).select(F.col("id").alias("node"), "text")
    sets = written(packed_sets(text_of.join(wanted.hint("merge"), "node", "left_semi"), words), "sets")

    def labelled(label: DataFrame, rows: DataFrame) -> DataFrame:
        """rows with a node and its component."""
        named = label.select(F.bitwise_not("node").alias("key"), "component")
        return rows.withColumn("key", F.bitwise_not("node")).join(named, "key", "left").select(*rows.columns, F.coalesce("component", "node").alias("component"))

    def still_open(state: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components; key is the bucket, in a form that isn't aggregated by."""
        several = state.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
        return state.withColumn("key", F.bitwise_not("band")).join(several.select(F.bitwise_not("band").alias("key")), "key").drop("key")

    pairs = written(members.where("hub < node").groupBy("node").agg(F.min("hub").alias("hub")).select("hub", "node"), "pairs")
    linked = lambda found: found.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    known = lambda label: label.select(F.col("component").alias("a"), F.col("node").alias("b"))
    first = written(compared(pairs, sets, percent), "compared")
    label = written(components(linked(first)), "labels")
    state = written(still_open(labelled(label, members.select("band", "node", "n"))), "open")
    if not state.isEmpty():
        some = sets.join(state.select("node").distinct().hint("merge"), "node", "left_semi")
        ranges = max(1, int(state.select("node", "n").distinct().agg(F.sum("n")).first()[0] // 1_500_000))
        counts = shared_counts(some, ranges).where("shared > 0").select(F.bitwise_not("node").alias("key"), "shared")
        state = state.withColumn("key", F.bitwise_not("node")).join(counts, "key").drop("key")
        # a partner has at least percent % of the size, so this much of a set must be found elsewhere
        state = written(still_open(state.where((100 + percent) * F.col("shared") >= percent * (F.col("n") + F.col("n") * percent / 100))), "open")
    if not state.isEmpty():
        # a hub near the middle of its bucket: little of its set is its own
        hub = state.groupBy("band").agg(F.max_by("node", F.struct(F.col("shared") / F.col("n"), F.xxhash64("node"))).alias("hub"))
        state = written(state.withColumn("key", F.bitwise_not("band")).join(hub.select(F.bitwise_not("band").alias("key"), "hub"), "key").drop("key"), "hubs")
        second = written(compared(state.where("hub != node").select("hub", "node").distinct(), sets, percent), "compared")
        label = written(components(known(label).union(linked(second))), "labels")
        state = still_open(labelled(label, state.drop("component")))
        inside = second.select(F.bitwise_not("node").alias("key"), "hub", "both")
        state = state.withColumn("key", F.bitwise_not("node")).join(inside, ["key", "hub"], "left").select("band", "node", "component", "n", "shared", F.coalesce("both", "n").alias("h"))
        # a pair is made in the first of the buckets that it shares; a node is in at most `bands` of them
        all_of = state.groupBy("node").agg(F.collect_list("band").alias("all")).select(F.bitwise_not("node").alias("key"), "all")
        blocks = state.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).select(F.bitwise_not("band").alias("bucket"), "blocks")
        state = state.withColumn("key", F.bitwise_not("node")).join(all_of, "key").drop("key")
        state = written(state.withColumn("bucket", F.bitwise_not("band")).join(blocks, "bucket").drop("bucket"), "open")
        # sets that link differ in size by less than a class and a bit: they are in the same class or the next one
        size_class = F.floor(F.log("n") / F.log(F.lit(100 / percent)) - 1e-9).cast("int")
        side = lambda x: (F.col("band"), F.col("node").alias(x), F.col("all").alias(f"all{x}"), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("h").alias(f"h{x}"), (F.col("shared") - F.col("h")).alias(f"e{x}"))
        left = state.select(*side("x"), size_class.alias("class"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
        near = F.array(size_class - 1, size_class, size_class + 1)
        right = state.select(*side("y"), F.explode(near).alias("class"), "blocks").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        ways = left.join(right.hint("merge"), ["band", "class", "block"]).where((F.col("cx") < F.col("cy")) & _could_link(percent) & (F.col("band") == F.array_min(F.array_intersect("allx", "ally"))))
        pairs = written(ways.select(F.least("x", "y").alias("hub"), F.greatest("x", "y").alias("node")).distinct(), "pairs")
        third = written(compared(pairs, sets, percent), "compared")
        if not (more := linked(third)).isEmpty():
            label = written(components(known(label).union(more)), "labels")

    discard(members, sets)
    named = narrow.select(F.bitwise_not("node").alias("key"), "id", "n", "node").join(label.select(F.bitwise_not("node").alias("key"), "component"), "key", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    apart = found.where(F.col("id").isNull() | (F.col("n") == 0)).select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return named.union(apart).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each component, the one with the least id."""
    gone = groups(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col("id").alias("__gone"))
    return docs.join(gone.hint("merge"), docs[id_col] == F.col("__gone"), "left_anti")
