"""How the sources of each language differ: exact divergences of their term frequencies, pair by pair and term by term.

1. Byte-level tokenizer. The UTF-8 buffers of a run of texts are laid end to end; a lookup table of 256 bytes folds A-Z
   and marks what ends a term, and terms begin and end where the marks change or a text does. No text is decoded.
2. Slices are grouped by xxhash; every slice is then compared byte by byte with the first of its hash, and those that
   differ get groups of their own. A run yields occurrences and documents of each (language, source, term).
3. Spark sums the runs' counts, keeps terms of enough documents of their language, and gives each count its share in
   billionths by exact division.
4. Shares are dealt out in blocks of terms; a block is a CSR matrix of sources by terms, whose distances between rows
   are sums over stored entries only (reduceat over the row pointers), unstored ones being one constant a row. Spark
   adds the blocks up and ranks.

Scale: tokens never leave a task, only counts do; a block holds at most about BLOCK_CELLS entries, whatever the size of
the vocabulary. Every pair of sources of a language is a row of the result, so blocks too have a row a pair.

Defined results
* null text, language and source count as empty strings; a text without terms still makes its group occur.
* rows that repeat an id are documents of their own; ids and other columns are never looked at.
* a language without kept terms gives pairs of value 0 and no terms; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import written

#: Bytes of text that a task counts at once; a longer text is counted on its own.
RUN_BYTES = 12_000_000
#: About how many entries, and rows times terms, a block of terms holds.
BLOCK_CELLS = 500_000
#: What is added to each count, and the shares' unit.
ADDED, UNIT = 5, 1_000_000_000


def fold_table() -> np.ndarray:
    """For each byte 0 if it ends a term, else the byte with A-Z folded."""
    table = np.zeros(256, np.uint8)
    for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[a : b + 1] = np.arange(a, b + 1)
    table[0x41:0x5B] += 0x20
    return table


_FOLD = fold_table()


def boundaries(folded: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms begin and end (exclusive) in folded bytes; a text's first byte begins a term anew."""
    inside = np.zeros(len(folded) + 1, bool)
    inside[:-1] = folded != 0
    first = np.zeros(len(folded) + 1, bool)
    first[text_starts] = True
    before = np.concatenate([[False], inside[:-1]])
    begins = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    return begins, ends


def grouped_slices(folded: np.ndarray, begins: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): slices in an order that keeps equal ones together and in place, and the group of each in it.

    Hashes propose groups; bytes decide: a slice that differs from the first of its hash is regrouped by its bytes.
    """
    data = memoryview(folded.tobytes())
    hashes = np.fromiter((digest(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())), np.uint64, len(begins))
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    group = np.cumsum(new) - 1
    first = order[np.flatnonzero(new)][group]
    odd = _unlike(folded, begins[order], ends[order], begins[first], ends[first])
    if len(odd):
        names: dict[bytes, int] = {}
        start = int(group[-1]) + 1
        for k in odd.tolist():
            i = order[k]
            group[k] = names.setdefault(bytes(data[begins[i] : ends[i]]), start + len(names))
        again = np.lexsort((order, group))
        order, group = order[again], group[again]
    return order, group


def _unlike(folded: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Places k where the slice at a[k] and that at b[k] aren't the same bytes; slices aren't empty."""
    out = []
    for s in range(0, len(a), step):
        x, y = a[s : s + step], b[s : s + step]
        n, m = a_end[s : s + step] - x, b_end[s : s + step] - y
        unlike = n != m
        check = np.flatnonzero(~unlike & (x != y))
        if len(check):
            sizes = n[check]
            starts = np.cumsum(sizes) - sizes
            at = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
            differ = folded[np.repeat(x[check], sizes) + at] != folded[np.repeat(y[check], sizes) + at]
            unlike[check[np.logical_or.reduceat(differ, starts)]] = True
        out.append(np.flatnonzero(unlike) + s)
    return np.concatenate(out) if out else np.zeros(0, int)


def count_run(texts: pa.Array, group_of_text: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of each group's terms in a run of texts without nulls."""
    by_group = np.argsort(group_of_text, kind="stable")
    texts, group_of_text = texts.take(pa.array(by_group)), group_of_text[by_group]
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    folded = _FOLD[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    begins, ends = boundaries(folded, offsets[:-1])
    if not len(begins):
        return np.zeros(0, int), [], np.zeros(0, int), np.zeros(0, int)
    text = np.searchsorted(offsets, begins, side="right") - 1
    order, term = grouped_slices(folded, begins, ends, digest)
    text = text[order]
    group = group_of_text[text]
    cell = np.ones(len(order), bool)
    cell[1:] = (term[1:] != term[:-1]) | (group[1:] != group[:-1])
    one_text = cell.copy()
    one_text[1:] |= text[1:] != text[:-1]
    at = np.flatnonzero(cell)
    data = folded.tobytes()
    terms = [data[a:b] for a, b in zip(begins[order[at]].tolist(), ends[order[at]].tolist())]
    return group[at], terms, np.diff(np.append(at, len(order))), np.add.reduceat(one_text.astype(np.int64), at)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, docs: sums over runs of texts, to be added up; each group has a row with an empty term too."""
    slim = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            # groups of the run, by language and source
            groups: dict[tuple[str, str], int] = {}
            keys = zip(table.column("lang").to_pylist(), table.column("source").to_pylist())
            of = np.fromiter((groups.setdefault(k, len(groups)) for k in keys), np.int64, table.num_rows)
            group, terms, n, texts = count_run(table.column("text").combine_chunks(), of)
            marks = np.arange(len(groups))
            who = pa.array(np.concatenate([marks, group]))
            out = pa.RecordBatch.from_pydict({
                "lang": pa.array([g[0] for g in groups], pa.string()).take(who),
                "source": pa.array([g[1] for g in groups], pa.string()).take(who),
                "term": pa.array([b""] * len(groups) + terms, pa.binary()).cast(pa.string()),
                "n": pa.array(np.concatenate([marks * 0, n])),
                "docs": pa.array(np.concatenate([marks * 0, texts])),
            })
            for k in range(0, out.num_rows, 50_000):
                yield out.slice(k, 50_000)

    return slim.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in runs of about RUN_BYTES; what a batch has beyond that is cut off by its row sizes."""
    held, size = [], 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, int)
        at = 0
        while at < batch.num_rows:
            done = lengths[at - 1] if at else 0
            to = min(max(int(np.searchsorted(lengths, done + RUN_BYTES - size, side="right")), at + 1), batch.num_rows)
            held.append(batch.slice(at, to - at))
            size += int(lengths[to - 1] - done)
            at = to
            if size >= RUN_BYTES or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * terms)), exact: the product is a decimal of 31 digits."""
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + ADDED).cast("decimal(19,0)"), (total + ADDED * terms).cast("decimal(20,0)"))


def distances(rows: np.ndarray, columns: np.ndarray, shares: np.ndarray, unstored: np.ndarray, n_columns: int) -> np.ndarray:
    """Sums of absolute differences between all rows of a CSR matrix whose unstored entries are unstored[row].

    Against a dense copy of one row at a time, the stored entries of all others are summed by reduceat over the row
    pointers; what they lack follows from that row's own entries and each row's constant.
    """
    size = len(unstored)
    order = np.lexsort((columns, rows))
    rows, columns, shares = rows[order], columns[order], shares[order]
    pointers = np.searchsorted(rows, np.arange(size + 1))
    filled = np.flatnonzero(np.diff(pointers))
    out = np.zeros((size, size), np.int64)
    for r in range(size):
        own = slice(pointers[r], pointers[r + 1])
        dense = np.full(n_columns, unstored[r], np.int64)
        dense[columns[own]] = shares[own]
        out[r] = np.abs(unstored[:, None] - shares[own][None, :]).sum(axis=1) + (n_columns - (own.stop - own.start)) * np.abs(unstored - unstored[r])
        if len(filled):
            here = dense[columns]
            extra = np.abs(shares - here) - np.abs(unstored[rows] - here)
            out[r, filled] += np.add.reduceat(extra, pointers[filled])
    return out


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, most_ranks: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of the language (part pair) by distance, and the terms
    that a source has above its language (part term) by excess, to rank most_ranks."""
    # dealt by language and term, so that one shuffle serves the sums and the documents of a term
    dealt = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = Window.partitionBy("lang", "term")
    summed = summed.withColumns({"in_docs": F.sum("docs").over(every), "in_lang": F.sum("n").over(every)})
    kept = written(summed.where((F.col("in_docs") >= least_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "in_lang"), "divergence-counts")

    # rows with an empty term name the groups that occur; each count row of a group adds to its totals
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.where("term != ''").groupBy("lang", "term").agg(F.first("in_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = groups.join(vocabulary, "lang", "left").fillna(0, ["terms", "lang_total"])
    groups = written(groups.withColumn("unstored", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(0))), "divergence-groups")
    shares = kept.where("term != ''").join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    excess = shares.withColumn("value", F.col("p") - share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))).where("value > 0")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = excess.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most_ranks)

    pairs = _pairs(shares, groups)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(first))
    return pairs.unionByName(terms)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for all ordered pairs of sources of a language."""
    size = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.count("*").alias("sources"))
    blocked = written(groups.join(size.drop("terms"), "lang").withColumn("blocks", F.expr(f"1 + terms * sources div {BLOCK_CELLS}")), "divergence-blocks")
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    cells = shares.join(blocked.select("lang", "source", "blocks"), ["lang", "source"]).select("lang", block.alias("block"), "source", "term", "p")
    rows = blocked.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "unstored")

    def partial(held: pa.Table, sources: pa.Table) -> pa.Table:
        names = sources.column("source").to_pylist()
        place = {s: k for k, s in enumerate(names)}
        at = np.fromiter((place[s] for s in held.column("source").to_pylist()), np.int64, held.num_rows)
        columns: dict[str, int] = {}
        of = np.fromiter((columns.setdefault(t, len(columns)) for t in held.column("term").to_pylist()), np.int64, held.num_rows)
        sums = distances(at, of, held.column("p").to_numpy(), sources.column("unstored").to_numpy(), len(columns))
        i, j = np.nonzero(~np.eye(len(names), dtype=bool))
        source, lang = pa.array(names, pa.string()), pa.array(sources.column("lang").to_pylist()[:1], pa.string())
        columns_out = [lang.take(pa.array(i * 0)), source.take(pa.array(i)), source.take(pa.array(j)), pa.array(sums[i, j])]
        return pa.Table.from_arrays(columns_out, names=["lang", "source", "item", "value"])

    parts = cells.groupBy("lang", "block").cogroup(rows.groupBy("lang", "block")).applyInArrow(partial, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
