"""Removal of passages that an earlier document holds, found by level-wise doubling.

A window of `window` words is looked for at about half its length first, that at half of it again, down to at most
eight words. Windows that no other document shares at one length are dropped; those that are shared alone are
extended to twice that length (the last length stops at `window`), a window's name being made of the names of its two
halves, until `window` is reached or no candidates survive. At the first length it is enough to look at the least
name within each window of the next length, about a quarter of all positions.

At the last length, where words are removed, a name has 128 bits, of two independent hashes of the words: at 1e14
windows the chance that any two different ones share a name is below 1e-10. Before that, 64 bits do, since a shared
name only keeps a candidate.

Every level works alike. A task gathers the names of its documents, in chunks of bounded size, sorts them and settles
within the chunk what it can: of the documents that share a name there, all but the one with the least id are
answered at once. What is left, one document a name, goes as packed arrays to the task that owns the name's range;
it answers those documents that share the name with one from another chunk. So a passage that a third of all
documents hold sends one row a chunk. Answers meet their texts by id and text hash (`key`) for the next level, so that rows
that repeat an id with other texts keep their own positions; ids alone say what is earlier.

Defined results
* null texts have no words. Texts shorter than the window lose nothing.
* a row with a null id is never earlier than another one and loses nothing.
* rows that repeat an id aren't earlier than each other; each loses what documents with smaller ids hold.
* passages repeated within one document only stay. An empty table gives an empty result.
* other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.minhash import MEMO, mixed
from lodestream.session import discard, small_batches, written

#: Names that a task holds before it settles them, and that the owner of a range gets on average; the least number of
#: ranges, so that tables of any size are dealt widely and answers in rows of (range, document) grow with the documents.
CHUNK, RANGE, RANGES = 500_000, 1_000_000, 64
#: The first length is at most this.
SHORTEST = 8


class _Names(dict):
    def __init__(self, seed: int = 0):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


_NAMES, _SECOND = _Names(), _Names(1)


def lengths(window: int) -> list[int]:
    """The lengths of the levels: each at most twice the one before, the last `window`."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def first_names(words: list[bytes], length: int, of: _Names = _NAMES) -> np.ndarray:
    """A 64-bit name of each run of `length` words."""
    w = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
    n = len(w) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for j in range(length):
        x = x * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    return mixed(x)


def extended(names: np.ndarray, length: int, to: int) -> np.ndarray:
    """Names of runs of `to` words from those of runs of `length` words, to <= 2 * length: first and last half."""
    n = len(names) - (to - length)
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mixed(names[:n] * np.uint64(0xD6E8FEB86659FD93) + names[to - length :][:n] * np.uint64(0xA0761D6478BD642F) + np.uint64(to))


def level_names(words: list[bytes], levels: list[int]) -> np.ndarray:
    """Names at the last of `levels`."""
    x = first_names(words, levels[0])
    for a, b in zip(levels, levels[1:]):
        x = extended(x, a, b)
    return x


def least_within(names: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each `span` consecutive names stands (the first of equals)."""
    if len(names) < span:
        return np.zeros(0, np.int64)
    return sliding_window_view(names, span).argmin(1) + np.arange(len(names) - span + 1)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _answers(name: np.ndarray, second: np.ndarray, id_: np.ndarray, smaller: bool) -> tuple[np.ndarray, np.ndarray]:
    """For names in order, with ids in order within a name: which entries are answered, and which stand for their name.

    smaller: answered are those whose name a smaller id has; else those whose name another id has.
    """
    starts = np.union1d(_runs(name), _runs(second))
    if not len(starts):
        return np.zeros(0, bool), np.zeros(0, bool)
    size = np.diff(np.append(starts, len(name)))
    least = np.repeat(id_[starts], size)
    leads = id_ == least
    if smaller:
        return ~leads, leads
    shared = np.repeat(id_[np.append(starts[1:], len(name)) - 1], size) != least
    return shared, leads


def _by_document(id_: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """One row an id and key: its positions in order, as differences."""
    order = np.lexsort((at, key, id_))
    id_, key, at = id_[order], key[order], at[order]
    starts = np.union1d(_runs(id_), _runs(key))
    return id_[starts].tolist(), key[starts].tolist(), [np.diff(p, prepend=0).astype("<i4").tobytes() for p in np.split(at, starts[1:])] if len(starts) else []


def _positions(parts: list[bytes] | None) -> np.ndarray:
    return np.concatenate([np.cumsum(np.frombuffer(p, "<i4")) for p in parts]) if parts else np.zeros(0, np.int64)


_OUT = "range int, names binary, seconds binary, ids binary, keys binary, at binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 5))], names=["range", "names", "seconds", "ids", "keys", "at"])


def shared_positions(docs: DataFrame, levels: list[int], smaller: bool, ranges: int, least_of: int = 1, last: bool = False) -> DataFrame:
    """id, key, at: the positions of each document's windows of levels[-1] words that another (or a smaller) id shares.

    docs has id, key, text and, after the first level, `known`: the positions that survived the level before. least_of over
    1 looks only at the least name within that many consecutive windows. `last` names windows by 128 bits.
    """
    final, first = levels[-1], len(levels) == 1

    def in_order(*columns: list[np.ndarray]) -> list[np.ndarray]:
        """Name, second, id, key, at by name and id."""
        x = [np.concatenate(c) for c in columns]
        order = np.lexsort((x[2], x[1], x[0]) if last else (x[2], x[0]))
        return [c[order] for c in x]

    def settle(*columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        name, second, id_, key, at = in_order(*columns)
        told, leads = _answers(name, second, id_, smaller)
        rows = []
        for doc, own_key, positions in zip(*_by_document(id_[told], key[told], at[told])):
            rows.append((xxhash.xxh3_64_intdigest(f"{doc} {own_key}") % ranges, None, None, np.int64(doc).tobytes(), np.int64(own_key).tobytes(), positions))
        # a name that is settled as shared still leads, for documents of other chunks
        name, second, id_, key, at = (x[leads] for x in (name, second, id_, key, at))
        owner = ((name >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cuts = np.searchsorted(owner, np.arange(1, ranges, dtype=np.uint64))
        rows += [(k, n.tobytes(), s.tobytes() if last else None, i.tobytes(), y.tobytes(), a.astype("<i4").tobytes()) for k, (n, s, i, y, a) in enumerate(zip(*(np.split(x, cuts) for x in (name, second, id_, key, at)))) if len(n)]
        for k in range(0, len(rows), 2000):
            yield _batch(rows[k : k + 2000])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seconds, ids, keys, ats, held = [], [], [], [], [], 0
        for batch in batches:
            known = None if first else batch.column("known")
            for k, (doc, key, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), batch.column("text"))):
                words = _split(text.as_py())
                if len(words) < final:
                    continue
                x = level_names(words, levels)
                if first:
                    at = np.unique(least_within(x, least_of)) if least_of > 1 else np.arange(len(x))
                else:
                    at = candidates(words, levels, _positions(known[k].as_py()), least_of)
                if len(at):
                    names.append(x[at])
                    seconds.append(first_names(words, final, _SECOND)[at] if last else np.zeros(len(at), np.uint64))
                    ids.append(np.full(len(at), doc, np.int64))
                    keys.append(np.full(len(at), key, np.int64))
                    ats.append(at)
                    held += len(at)
                if held >= CHUNK:
                    yield from settle(names, seconds, ids, keys, ats)
                    names, seconds, ids, keys, ats, held = [], [], [], [], [], 0
        if held:
            yield from settle(names, seconds, ids, keys, ats)

    def own(table: pa.Table) -> pa.Table:
        docs_, texts, positions, names, seconds, ids, keys, ats = [], [], [], [], [], [], [], []
        for n, s, i, y, a in zip(*(table.column(c).to_pylist() for c in ("names", "seconds", "ids", "keys", "at"))):
            if n is None:
                docs_.append(int(np.frombuffer(i, "<i8")[0]))
                texts.append(int(np.frombuffer(y, "<i8")[0]))
                positions.append(a)
            else:
                names.append(np.frombuffer(n, "<u8"))
                seconds.append(np.frombuffer(s, "<u8") if last else np.zeros(len(names[-1]), np.uint64))
                ids.append(np.frombuffer(i, "<i8"))
                keys.append(np.frombuffer(y, "<i8"))
                ats.append(np.frombuffer(a, "<i4"))
        if names:
            name, second, id_, key, at = in_order(names, seconds, ids, keys, ats)
            told, _ = _answers(name, second, id_, smaller)
            more = _by_document(id_[told], key[told], at[told].astype(np.int64))
            docs_, texts, positions = docs_ + more[0], texts + more[1], positions + more[2]
        return pa.table({"id": pa.array(docs_, pa.int64()), "key": pa.array(texts, pa.int64()), "at": pa.array(positions, pa.binary())})

    packed = docs.mapInArrow(gather, _OUT)
    told = packed.groupBy("range").applyInArrow(own, "id long, key long, at binary")
    return told.groupBy("id", "key").agg(F.collect_list("at").alias("at"))


def candidates(words: list[bytes], levels: list[int], known: np.ndarray, least_of: int) -> np.ndarray:
    """Where windows of levels[-1] words begin whose parts of the level before all survived there (`known`)."""
    before, now = levels[-2], levels[-1]
    n = len(words) - now + 1
    alive = np.zeros(len(words) - before + 1, bool)
    alive[known] = True
    if len(levels) == 2 and least_of > 1:
        at = least_within(level_names(words, levels[:1]), now - before + 1)
        return np.flatnonzero(alive[at[:n]])
    return np.flatnonzero(alive[:n] & alive[now - before :][:n])


def repeated_windows(docs: DataFrame, window: int, smaller: bool = True) -> DataFrame:
    """id, key, at: packed positions of windows that another document shares (smaller: one with a smaller id); docs has id, key, text."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    levels = lengths(window)
    docs = docs.where(F.col("id").isNotNull())
    sparse = levels[1] - levels[0] + 1 if len(levels) > 1 else 1
    share = 2 / (sparse + 1)
    now, found = docs, None
    for k in range(1, len(levels) + 1):
        ranges = max(RANGES, round(chars / 6 * share / RANGE))
        found, before = written(shared_positions(now, levels[:k], smaller and k == len(levels), ranges, sparse if k <= 2 else 1, k == len(levels)), "repeats"), found
        discard(before)
        if k == len(levels) or found.isEmpty():
            return found
        now = docs.join(found.withColumnRenamed("at", "known").hint("merge"), ["id", "key"])
        share = 0.5


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every row of `docs`; with_text adds kept, the words that stay."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    found = repeated_windows(slim, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, kept = [], [], [], []
            for text, at in zip(batch.column("text"), batch.column("at")):
                words = _split(text.as_py())
                ends = np.zeros(len(words) + 1, np.int64)
                if at.is_valid:
                    # rows that repeat both id and text give each position again
                    p = np.unique(_positions(at.as_py()))
                    ends[p] += 1
                    ends[p + window] -= 1
                covered = np.cumsum(ends[:-1]) > 0
                stay = b" ".join([w for w, c in zip(words, covered.tolist()) if not c] if covered.any() else words)
                n.append(len(words))
                gone.append(int(covered.sum()))
                digest.append(hashlib.sha256(stay).hexdigest())
                if with_text:
                    kept.append(stay.decode())
            arrays = [batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), *[pa.array(kept, pa.string())] * with_text]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])

    rows = slim.join(found.hint("merge"), ["id", "key"], "left").select("id", "text", "at")
    return rows.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
