"""How many items of an array are worth keeping, and which: arrays as rows (array, pos, item), pos counted from 0.

An array of more than eight items is judged by how many of its items are alike (greedy clusters of 64-bit hashes),
by where its curve of distinct word pairs bends, and by whether the first k items deflate as well as the whole.

Nothing here holds a whole array in a task: hashes are made row by row, clusters come from a graph in rounds, curves
from sums over chunks of positions; only deflating, which is sequential, passes an array through one task in order,
item by item.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators.selection import k_split
from lodestream.session import discard, small_batches, written

#: Arrays up to this length stay whole; alike is up to this many differing bits; the bend's least height.
WHOLE, ALIKE, LEAST_GAIN = 8, 3, 0.05
#: Shares kept without a bend, the diversity from which a floor holds, the ratio gap and the growth by it.
BASE_SHARE, DIVERSE, RATIO_GAP, GROWTH, LEAST_BYTES = 0.3, 0.7, 0.15, 1.2, 200
#: Characters in a gram, characters hashed at once, and grams that a worker remembers at most.
GRAM, RUN, MEMO = 4, 1 << 18, 500_000
_GRAMS: dict[str, int] = {}
_DIGESTS: dict[str, bytes] = {}
#: Most nodes of an array that are compared all with all.
FEW = 256
#: Positions in a chunk of a running sum.
CHUNK = 4096


def hash_of(text: str) -> int:
    """64 bits by majority over the first eight MD5 bytes of a text's four-character grams; short texts are one gram."""
    return int(hashes_of([text])[0])


def _gram_hash(gram: str) -> int:
    return int.from_bytes(hashlib.md5(gram.encode()).digest()[:8], "big")


def hashes_of(texts: list[str], memo: dict | None = None) -> np.ndarray:
    """The hashes of many texts: grams are numbers of 64 bits, each distinct one is digested once, and bits are summed."""
    memo = {} if memo is None else memo
    out = np.zeros(len(texts), np.uint64)
    held: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if len(text) <= GRAM:  # one gram, whose majority is itself
            out[k] = _gram_hash(text)
            continue
        held.append(k)
        size += len(text)
        if size >= RUN:
            out[held] = _run_hashes([texts[j] for j in held], memo)
            held, size = [], 0
    if held:
        out[held] = _run_hashes([texts[j] for j in held], memo)
    return out


def _run_hashes(texts: list[str], memo: dict) -> np.ndarray:
    """Hashes of texts longer than a gram, laid end to end; a character is 16 bits, numbered where it has more."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    known = None
    if codes.max() >= 1 << 16:
        known, codes = np.unique(codes, return_inverse=True)
        if len(known) > 1 << 16:  # more characters than numbers: halves have fewer
            if len(texts) == 1:
                votes = np.zeros(64, np.int64)
                for i in range(len(texts[0]) - GRAM + 1):
                    h = _gram_hash(texts[0][i : i + GRAM])
                    votes += np.array([1 if h >> j & 1 else -1 for j in range(64)])
                return np.array([sum(1 << j for j in range(64) if votes[j] > 0)], np.uint64)
            half = len(texts) // 2
            return np.concatenate([_run_hashes(texts[:half], memo), _run_hashes(texts[half:], memo)])
    numbers = codes.astype(np.uint64)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(n)
    packed = numbers[: len(numbers) - GRAM + 1].copy()
    for k in range(1, GRAM):
        packed = packed << np.uint64(16) | numbers[k : len(numbers) - GRAM + 1 + k]
    inside = np.ones(len(packed), bool)
    for k in range(1, GRAM):  # grams don't run from one text into the next
        inside[ends[:-1] - k] = False
    grams, at = np.unique(packed[inside], return_inverse=True)
    if len(memo) > MEMO:
        memo.clear()
    if known is None:
        keys = grams.tolist()
    else:
        letters = [chr(c) for c in known.tolist()]
        keys = [letters[g >> 48] + letters[g >> 32 & 0xFFFF] + letters[g >> 16 & 0xFFFF] + letters[g & 0xFFFF] for g in grams.tolist()]
    found = list(map(memo.get, keys))
    for k, h in enumerate(found):
        if h is None:
            key = keys[k]
            gram = key if isinstance(key, str) else chr(key >> 48) + chr(key >> 32 & 0xFFFF) + chr(key >> 16 & 0xFFFF) + chr(key & 0xFFFF)
            found[k] = memo[key] = _gram_hash(gram)
    bits = np.unpackbits(np.array(found, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = n - GRAM + 1
    if len(texts) * len(grams) <= RUN:  # how often each text has each gram
        times = np.bincount(np.repeat(np.arange(len(texts)) * len(grams), counts) + at, minlength=len(texts) * len(grams))
        kind = np.float32 if len(codes) < 1 << 24 else np.float64  # counts are exact in it
        ones = times.reshape(len(texts), -1).astype(kind) @ bits.astype(kind)
    else:
        ones = np.add.reduceat(bits[at], np.cumsum(counts) - counts, axis=0, dtype=np.int32)
    return (np.uint64(1) << np.arange(64, dtype=np.uint64)) @ (2 * ones > counts[:, None]).T.astype(np.uint64)


def votes_of(text: str, memo: dict | None = None) -> np.ndarray:
    """For each of the 64 bits, the greatest first, how many more of a text's grams have it than lack it; a slice of RUN
    characters at a time, grams that repeat within one digested once."""
    memo, votes = _DIGESTS if memo is None else memo, np.zeros(64, np.int64)
    for start in range(0, max(1, len(text) - GRAM + 1), RUN):
        run = text[start : start + RUN + GRAM - 1]
        found = Counter(map("".join, zip(*(run[k:] for k in range(GRAM))))) if len(run) > GRAM else {run: 1}
        if len(memo) > MEMO:
            memo.clear()
        raw = b"".join([memo.get(g) or memo.setdefault(g, hashlib.md5(g.encode()).digest()[:8]) for g in found])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts = np.fromiter(found.values(), np.int64, len(found))
        votes += 2 * (counts.astype(np.float64) @ bits).astype(np.int64) - counts.sum()
    return votes


def item_hashes(items: Column) -> Column:
    """The hash of each text as a signed long; row by row, with a memo of grams for each batch."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(hashes_of(texts.tolist(), _GRAMS).astype(np.int64))

    return run(F.lower(items))


def close_pairs(nodes: DataFrame, most: int = ALIKE) -> DataFrame:
    """array, a, b: pairs of nodes (array, at, hash) with a before b whose hashes differ in `most` bits at most.

    Arrays of up to FEW nodes are compared within a row, all nodes with all; those of larger ones meet by blocks of bits.
    """
    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def compared(lists: pa.Array) -> pa.Array:
        ends, found = [0], [np.zeros((2, 0), np.int64)]
        for held in lists:
            at, bits = (held.values.field(k).to_numpy() for k in ("at", "hash"))
            bits = bits.view(np.uint64)
            x, y = np.nonzero((np.bitwise_count(bits[:, None] ^ bits) <= most) & (at[:, None] < at))
            found.append(np.stack([at[x], at[y]]))
            ends.append(ends[-1] + len(x))
        a, b = np.concatenate(found, axis=1)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]))

    small_batches(nodes.sparkSession)
    sizes = nodes.groupBy("array").agg(F.count("*").alias("n"))
    few = nodes.join(sizes.where(F.col("n").between(2, FEW)).select("array").hint("merge"), "array", "left_semi")
    few = few.groupBy("array").agg(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), F.col("hash").cast("long").alias("hash"))).alias("held"))
    few = few.select("array", F.explode(compared("held")).alias("pair")).select("array", "pair.a", "pair.b")
    many = nodes.join(sizes.where(F.col("n") > FEW).select("array").hint("merge"), "array", "left_semi")
    return few.unionByName(close_hashes(many, ["array"], most).select("array", "a", "b").distinct())


def close_hashes(nodes: DataFrame, by: list[str], most: int = ALIKE) -> DataFrame:
    """by, a, b, distance: pairs of nodes (by, at, hash) with a before b whose hashes differ in `most` bits at most.

    Bits are cut into most + 3 blocks, of which three must agree: pairs meet by the value of three blocks, so that a key
    says about half of the bits and few pairs meet in vain. A pair comes once for each three blocks that agree.
    """
    n = most + 3
    ends = [64 * k // n for k in range(n + 1)]
    block = [F.shiftrightunsigned("hash", a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(ends, ends[1:])]
    keys = []
    for three in combinations(range(n), 3):
        key = F.lit(0).cast("long")
        for k in three:
            key = F.shiftleft(key, ends[k + 1] - ends[k]).bitwiseOR(block[k])
        keys.append(key)
    keyed = nodes.select(*by, "at", "hash", F.posexplode(F.array(*keys)).alias("which", "key"))
    x, y = keyed.toDF(*by, "a", "ah", "which", "key"), keyed.toDF(*by, "b", "bh", "which", "key")
    distance = F.bit_count(F.col("ah").bitwiseXOR(F.col("bh")))
    met = x.join(y.hint("merge"), [*by, "which", "key"]).where((F.col("a") < F.col("b")) & (distance <= most))
    return met.select(*by, "a", "b", distance.alias("distance"))


def first_representatives(pairs: DataFrame) -> DataFrame:
    """array, at, representative of the nodes in `pairs` (array, a, b with a before b), as a pass in order would give.

    A node stands for itself unless an earlier representative is linked to it; of several the first counts. In each
    round the nodes without an undecided earlier neighbour stand for themselves, what is linked to them later is
    covered, and decided nodes leave the graph. Rounds are as many as the longest chain of links in ascending order.
    """
    left, decided, rounds = written(pairs.select("array", "a", "b"), "links"), [], 0
    every, ends = left, lambda df: df.select("array", F.explode(F.array("a", "b")).alias("at")).distinct()
    while not left.isEmpty():
        own = left.select("array", F.col("a").alias("at")).distinct().join(left.select("array", F.col("b").alias("at")).distinct().hint("merge"), ["array", "at"], "left_anti")
        own = written(own, f"links-own-{rounds}")
        covered = left.join(own.withColumnRenamed("at", "a").hint("merge"), ["array", "a"], "left_semi").select("array", F.col("b").alias("at")).distinct()
        state = written(own.withColumn("own", F.lit(True)).unionByName(covered.withColumn("own", F.lit(False))), f"links-round-{rounds}")
        rest = left
        for side in ("a", "b"):
            rest = rest.join(state.select("array", F.col("at").alias(side)).hint("merge"), ["array", side], "left_anti")
        rest = written(rest.select("array", "a", "b"), f"links-left-{rounds}")
        # nodes whose links have all gone without being covered stand for themselves
        gone = ends(left).join(state.select("array", "at").hint("merge"), ["array", "at"], "left_anti")
        free = written(gone.join(ends(rest).hint("merge"), ["array", "at"], "left_anti").withColumn("own", F.lit(True)), f"links-free-{rounds}")
        decided += [state, free]
        discard(own, *[left][: left is not every])
        left, rounds = rest, rounds + 1
    if not decided:
        return every.select("array", F.col("a").alias("at"), F.col("a").alias("representative"))
    # one scan of all rounds: a union's plan would grow with them
    state = every.sparkSession.read.schema(decided[0].schema).parquet(*[df._written_to for df in decided])
    owners = state.where("own").select("array", F.col("at").alias("a"))
    first = every.join(owners.hint("merge"), ["array", "a"], "left_semi").groupBy("array", F.col("b").alias("at")).agg(F.min("a").alias("representative"))
    joined = state.join(first.hint("merge"), ["array", "at"], "left")
    return joined.select("array", "at", F.when(F.col("own"), F.col("at")).otherwise(F.col("representative")).alias("representative"))


def clusters(items: DataFrame, most: int = ALIKE) -> DataFrame:
    """array, pos, representative: the position of the first representative that each item's hash is close to."""
    hashes = written(items.select("array", "pos", item_hashes(F.col("item")).alias("hash")), "hashes")
    nodes = written(hashes.groupBy("array", "hash").agg(F.min("pos").alias("at")), "hash-nodes")
    found = first_representatives(close_pairs(nodes, most))
    named = nodes.join(found.hint("merge"), ["array", "at"], "left").select("array", "hash", F.coalesce("representative", "at").alias("representative"))
    return hashes.join(named.hint("merge"), ["array", "hash"]).select("array", "pos", "representative")


def running_total(rows: DataFrame, value: str) -> DataFrame:
    """rows (array, pos, value) with total: sums up to each position, by chunks of positions, then within a chunk."""
    chunked = rows.withColumn("chunk", F.expr(f"pos div {CHUNK}"))
    sums = chunked.groupBy("array", "chunk").agg(F.sum(value).alias("here"))
    before = F.coalesce(F.sum("here").over(W.partitionBy("array").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = chunked.join(sums.select("array", "chunk", before.alias("before")).hint("merge"), ["array", "chunk"])
    inner = F.sum(value).over(W.partitionBy("array", "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn("total", inner + F.col("before")).drop("chunk", "before")


def pair_curve(items: DataFrame) -> DataFrame:
    """array, pos, total: how many distinct pairs of neighbouring words in lower case items have brought so far."""
    words = F.filter(F.split(F.lower("item"), r"\s+"), lambda w: w != "")
    pair = F.when(F.size("words") < 2, F.array(F.concat(F.coalesce(F.get("words", F.lit(0)), F.lit("")), F.lit(" "))))
    pair = pair.otherwise(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat(F.get("words", i - 1), F.lit(" "), F.get("words", i))))
    first = items.select("array", "pos", words.alias("words")).select("array", "pos", F.explode(pair).alias("pair")).groupBy("array", "pair").agg(F.min("pos").alias("pos"))
    new = first.groupBy("array", "pos").agg(F.count("*").alias("new"))
    all_items = items.select("array", "pos").join(new.hint("merge"), ["array", "pos"], "left").fillna(0, ["new"])
    return running_total(all_items, "new").select("array", "pos", "total")


def bend(curve: DataFrame) -> DataFrame:
    """array, knee: items up to where the curve lies highest above its chord; 1 if flat, null if it lies too low."""
    whole = curve.groupBy("array").agg(F.min("total").alias("low"), F.max("total").alias("high"), F.count("*").alias("n"))
    gain = (F.col("total") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0)) - F.col("pos") / F.nullif(F.col("n") - 1, F.lit(0))
    best = curve.join(whole.hint("merge"), "array").withColumn("gain", gain).groupBy("array").agg(
        F.max(F.struct("gain", (-F.col("pos")).alias("back"))).alias("best"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("n").alias("n")
    )
    knee = F.when(F.col("n") < 3, F.lit(None)).when(F.col("high") == F.col("low"), F.lit(1)).when(F.col("best.gain") >= LEAST_GAIN, 1 - F.col("best.back"))
    return best.select("array", knee.cast("long").alias("knee"))


def deflated_ratios(items: DataFrame, level: int = 1) -> DataFrame:
    """array, bytes, whole, first: bytes of the items joined by line ends, their deflated share, and that of the first k.

    items: array, pos, item, k. Arrays are dealt out whole and read in order; a task holds one item at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packer, sizes = None, None, [0, 0]
        rows: list[tuple] = []
        part = 0.0

        def close() -> None:
            rows.append((current, sizes[0], (sizes[1] + len(packer.flush())) / sizes[0] if sizes[0] else 1.0, part))

        for batch in batches:
            for array, pos, item, k in zip(*(batch.column(c).to_pylist() for c in ("array", "pos", "item", "k"))):
                if packer is None or array != current:
                    if packer is not None:
                        close()
                    current, packer, sizes, part = array, zlib.compressobj(level), [0, 0], 1.0
                raw = ("\n" if pos else "").encode() + item.encode()
                sizes[0] += len(raw)
                sizes[1] += len(packer.compress(raw))
                if pos == k - 1 and sizes[0]:
                    part = (sizes[1] + len(packer.copy().flush())) / sizes[0]
            if len(rows) > 1000:
                yield _ratio_batch(rows)
                rows.clear()
        if packer is not None:
            close()
        yield _ratio_batch(rows)

    dealt = items.select("array", "pos", "item", "k").repartition("array").sortWithinPartitions("array", "pos")
    return dealt.mapInArrow(run, "array string, bytes long, whole double, first double")


def _ratio_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("array", pa.string()), ("bytes", pa.int64()), ("whole", pa.float64()), ("first", pa.float64()))
    return pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})


def optimal_k(items: DataFrame, bias: float = 1.0, min_k: int = 3, max_k: int | None = None, deflate: bool = True) -> DataFrame:
    """array, n, clusters, knee, k: how many items each array should keep.

    Up to eight items all stay; of arrays with three clusters at most, as many as there are clusters. Otherwise k is
    the bend, at least a share that grows with diversity where there is no bend or most items differ, times bias. If
    the first k deflate otherwise than the whole (`deflate`), k grows. k lies within min_k and max_k.

    items: array (string), pos (from 0), item (string). An array without rows has no result; null items are empty.
    """
    items = written(items.select("array", "pos", F.coalesce("item", F.lit("")).alias("item")), "array-items")
    sizes = items.groupBy("array").agg(F.count("*").alias("n"))
    large = items.join(sizes.where(F.col("n") > WHOLE).select("array").hint("merge"), "array", "left_semi")
    alike = clusters(large).groupBy("array").agg(F.countDistinct("representative").alias("clusters"))
    known = sizes.join(alike.hint("merge"), "array", "left").join(bend(pair_curve(large)).hint("merge"), "array", "left")
    n, kinds, knee = F.col("n"), F.col("clusters"), F.col("knee")
    cap = F.lit(max_k) if max_k is not None else n
    share = F.floor(n * (F.lit(BASE_SHARE) + F.lit(1 - BASE_SHARE) * (kinds / n)))
    floor = F.greatest(F.lit(min_k), share)
    chosen = F.when(knee.isNull(), floor).when(kinds / n > DIVERSE, F.greatest(knee, floor)).otherwise(knee)
    k = F.least(F.greatest(F.lit(min_k), F.floor(chosen * F.lit(float(bias)))), cap)
    few = F.least(F.greatest(F.lit(min_k), kinds), cap)
    known = known.withColumn("k", F.when(n <= WHOLE, n).when(kinds <= 3, few).otherwise(k).cast("long"))
    if not deflate:
        return known.select("array", "n", "clusters", "knee", "k")
    known = written(known, "array-k")
    open_ones = known.where((n > WHOLE) & (kinds > 3) & (F.col("k") < n) & (F.col("k") < cap)).select("array", "k")
    ratios = deflated_ratios(items.join(open_ones.hint("merge"), "array")).withColumnRenamed("bytes", "size")
    grown = F.least(F.floor(F.col("k") * GROWTH), cap)
    off = (F.col("size") >= LEAST_BYTES) & (F.abs(F.col("whole") - F.col("first")) > RATIO_GAP)
    known = known.join(ratios.hint("merge"), "array", "left").withColumn("k", F.when(off, F.greatest(F.lit(min_k), grown)).otherwise(F.col("k")).cast("long"))
    return known.select("array", "n", "clusters", "knee", "k")


def edges(k: Column) -> tuple[Column, Column]:
    """How many of k places go to an array's first and last items; together not more than k."""
    first, last, _ = k_split(k)
    first = F.least(first, k)
    return first, F.least(last, k - first)


def sampled(items: DataFrame, budgets: DataFrame, distinct: bool = True) -> DataFrame:
    """array, pos, why of all items: whole, marked, edge, stride or dropped.

    items: array, pos, item, must (stays whatever k) and extra (by how much it raises the limit of strides); budgets:
    array, n, k. Places that are left of k go to items at even strides; with `distinct`, one that equals a kept item or
    one at an earlier stride takes none.
    """
    first, last = edges(F.col("k"))
    at = items.join(budgets.select("array", "n", "k").hint("merge"), "array").withColumn("kept", F.col("must") | (F.col("pos") < first) | (F.col("pos") >= F.col("n") - last))
    at = written(at, "sampled")
    sums = at.groupBy("array").agg(F.sum(F.col("kept").cast("int")).alias("n_kept"), F.sum("extra").alias("extra"), F.max("k").alias("k"), F.max("n").alias("n"))
    room = F.greatest(F.col("k") - F.col("n_kept"), F.lit(0))
    step = F.greatest(F.lit(1).cast("long"), F.expr("(n - 1) div (room + 1)"))
    sums = sums.withColumn("room", room).withColumn("step", step).withColumn("places", F.col("k") + F.col("extra") - F.col("n_kept"))
    open_ones = sums.where((F.col("room") > 0) & (F.col("n") > WHOLE)).select("array", "step", "places")
    tried = at.where(~F.col("kept")).join(open_ones.hint("merge"), "array").where(F.col("pos") % F.col("step") == 0)
    if distinct:
        tried = tried.join(at.where("kept").select("array", "item").distinct().hint("merge"), ["array", "item"], "left_anti")
        tried = tried.groupBy("array", "item").agg(F.min("pos").alias("pos"), F.first("places").alias("places"))
    nth = F.row_number().over(W.partitionBy("array").orderBy("pos"))
    strided = tried.withColumn("nth", nth).where(F.col("nth") <= F.col("places")).select("array", "pos", F.lit(True).alias("strided"))
    why = F.when(F.col("n") <= WHOLE, "whole").when(F.col("must"), "marked").when(F.col("kept"), "edge").when(F.col("strided"), "stride").otherwise("dropped")
    return at.join(strided.hint("merge"), ["array", "pos"], "left").select("array", "pos", why.alias("why"))


def away(items: DataFrame, value: str, sigmas: float = 2.0) -> DataFrame:
    """items with `deviation` and `away`: whether a value lies more than `sigmas` sample deviations from its array's mean."""
    stats = items.groupBy("array").agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("deviation"))
    strays = F.coalesce((F.col("deviation") > 0) & (F.abs(F.col(value) - F.col("__mean")) > sigmas * F.col("deviation")), F.lit(False))
    return items.join(stats.hint("merge"), "array").withColumn("away", strays).drop("__mean")


def changes(items: DataFrame, value: str, window: int = 5, sigmas: float = 2.0) -> DataFrame:
    """array, pos of the change points: the means of the `window` values before and from there on differ by `sigmas` deviations.

    items as from `away`. Each value is sent to the positions whose windows it lies in, so no task needs the whole array.
    """
    sent = items.select("array", F.explode(F.sequence(F.col("pos") - window + 1, F.col("pos") + window)).alias("pos"), F.col("pos").alias("of"), F.col(value).alias("x"))
    before, after = F.avg(F.when(F.col("of") < F.col("pos"), F.col("x"))), F.avg(F.when(F.col("of") >= F.col("pos"), F.col("x")))
    means = sent.groupBy("array", "pos").agg(before.alias("before"), after.alias("after"))
    whole = items.groupBy("array").agg(F.count("*").alias("n"), F.max("deviation").alias("deviation"))
    inside = (F.col("n") > 2 * window) & (F.col("pos") >= window) & (F.col("pos") < F.col("n") - window)
    return means.join(whole.hint("merge"), "array").where(inside & (F.col("deviation") > 0) & (F.abs(F.col("after") - F.col("before")) > sigmas * F.col("deviation"))).select("array", "pos")
