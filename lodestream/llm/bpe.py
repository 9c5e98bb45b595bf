"""Byte-level BPE encoding and decoding of whole texts with a compiled lexicon of frequent words.

1. Words are counted over all documents (per task, then summed by Spark).
2. The most frequent `lexicon_words` are merged once and compiled into a minimal acyclic transducer (`lexicon`),
   which Spark hands to the executors as a file and each Python worker maps into memory.
3. Texts are split as the tokenizer's byte-level pre-tokenizer does; a word's ids come from the transducer, or for
   words that it lacks from merging by rank, which gives the same ids. A bounded memo in each worker holds words that
   it has met.

The lexicon's size is a parameter and bounds what the driver gathers; it never changes a result.

Defined results
* null and empty texts have no tokens; both digests are then those of the empty string.
* an added token's string within a text is that one token, as in the tokenizers library.
* very long words are merged with a heap, in n log n.
* tokenizer files with settings that this operator doesn't know are refused.
* repeated rows are encoded alike; null ids are carried; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.lexicon import Lexicon, compile_lexicon
from lodestream.session import put_bytes, written

#: The split pattern of byte-level pre-tokenizers of this family (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same within ASCII, for texts that hold nothing else.
ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Words that a worker remembers at most.
MEMO = 800_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary from a tokenizers JSON file. Objects travel to the workers by pickle."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.json = f.read()
        spec = json.loads(self.json)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE":
            raise ValueError("this operator reads byte-level BPE without normaliser or prefix space")
        if model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("dropout, ignored merges, byte fallback, affixes of subwords and other decoders aren't supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with strip or word rules aren't supported")
        self.pattern = self._pattern()

    def _pattern(self) -> str:
        """SPLIT with the classes of the tokenizer's own Unicode tables, which may be of another version than those of `regex`.

        The code points that the two class differently are found by probing: a run of one class is one piece for the
        tokenizer unless a code point of another class breaks it. Each of those is then probed beside every class.
        """
        from tokenizers.pre_tokenizers import ByteLevel

        split, odd = ByteLevel(add_prefix_space=False), []
        kinds = (("a", regex.compile(r"\p{L}+")), ("1", regex.compile(r"\p{N}+")), (" ", regex.compile(r"\s+")), ("!", regex.compile(r"[^\s\p{L}\p{N}]+")))
        for block in range(0, 0x110000, 0x800):
            some = "" if 0xD800 <= block < 0xE000 else "".join(map(chr, range(block, block + 0x800)))
            for anchor, kind in kinds:
                run = anchor + "".join(kind.findall(some))
                if len(split.pre_tokenize_str(run)) > 1:
                    odd += [ord(c) for c in run if c not in "'\n\t " and len(split.pre_tokenize_str(anchor + c + anchor)) > 1]
        moved: dict[str, list[int]] = {anchor: [] for anchor, _ in kinds}
        self.odd = sorted(set(odd))
        for c in self.odd:
            own = [anchor for anchor in "a1!" if len(split.pre_tokenize_str(anchor + chr(c) + anchor)) == 1]
            moved[own[0] if own else " "].append(c)

        def ranges(codes: list[int]) -> str:
            out: list[list[int]] = []
            for c in codes:
                if out and out[-1][1] == c - 1:
                    out[-1][1] = c
                else:
                    out.append([c, c])
            return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

        if not odd:
            return SPLIT
        every = ranges(self.odd)
        of = {k: f"[[{name}--[{every}]]" + (f"||[{ranges(moved[anchor])}]" if moved[anchor] else "") + "]" for anchor, k, name in (("a", "L", r"\p{L}"), ("1", "N", r"\p{N}"), (" ", "S", r"\s"))}
        other = f"[^{of['S']}{of['L']}{of['N']}]"
        not_space = f"[^{of['S']}]"
        return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{of['L']}+| ?{of['N']}+| ?{other}+|{of['S']}+(?!{not_space})|{of['S']}+"

    def __getstate__(self) -> dict:
        return {"json": self.json, "pattern": self.pattern, "odd": self.odd}

    def open(self) -> ByteBpe:
        """Build the tables for use; cheap enough for once a worker."""
        spec = json.loads(self.json)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.byte_id = [vocab[c] for c in letters]
        self.rank: dict[int, int] = {}
        self.made = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.piece = [b""] * size
        for token, i in vocab.items():
            self.piece[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            self.piece[i] = token.encode()
        self.added_at = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._split, self._plain, self._ascii = regex.compile(self.pattern).findall, regex.compile(SPLIT).findall, re.compile(ASCII_SPLIT, re.ASCII).findall
        self._is_odd = np.zeros(0x110000, bool)
        self._is_odd[self.odd] = True
        self._ascii_odd = bool(self._is_odd[:128].any())
        return self

    def words(self, text: str) -> list[str]:
        """Pieces that are merged on their own, between added tokens. Only texts with a code point that is classed otherwise need the slow pattern."""
        if text.isascii() and not self._ascii_odd:
            return self._ascii(text)
        if self.odd and self._is_odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return self._split(text)
        return self._plain(text)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of least rank, leftmost first, is merged until none is left."""
        ids = [self.byte_id[b] for b in word]
        get, none = self.rank.get, 1 << 60
        if len(ids) > 64:
            return self._merge_long(ids)
        pairs = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            ids[i] = new = self.made[best]
            del pairs[i], ids[i + 1]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 32 | new, none)
            if i < len(pairs):
                pairs[i] = get(new << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: bytes) -> str:
        """Text of ids given as little-endian 32-bit integers; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Memo(dict):
    """Word to ids: filled from the lexicon, else by merging. When half of MEMO is met, the words of the half before go."""

    def __init__(self, bpe: ByteBpe, lexicon: Lexicon):
        self.bpe, self.lexicon, self.before = bpe, lexicon, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            raw = word.encode()
            ids = self.lexicon.get(raw)
            if ids is None:
                ids = array("I", self.bpe.merge(raw)).tobytes()
            if len(raw) > 128:
                return ids
        if len(self) >= MEMO // 2:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    def __init__(self, bpe: ByteBpe, lexicon: Lexicon):
        self.bpe, self.memo = bpe, _Memo(bpe, lexicon)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        ids, added = self.memo.__getitem__, self.bpe.added
        if self.bpe.added_at and any(t in text for t in added):
            return b"".join(added[x].to_bytes(4, "little") if x in added else b"".join(map(ids, self.bpe.words(x))) for x in self.bpe.added_at.split(text) if x)
        return b"".join(map(ids, self.bpe.words(text)))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: how often each piece between white space occurs in all texts, with a leading space where it has one.

    Each task counts in memory and hands on its table whenever it holds MEMO words; Spark sums them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(SPLIT).findall
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            pieces: Counter[str] = Counter()
            for w, n in found.items():
                if w.isalpha():  # one piece
                    pieces[" " + w] += n
                    continue
                for p in split(" " + w):
                    pieces[p] += n
            return pa.RecordBatch.from_pydict({"word": pa.array(pieces.keys(), pa.string()), "n": pa.array(pieces.values(), pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update((text or "").split())
                if len(found) >= MEMO:
                    yield out()
                    found.clear()
        yield out()

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int, text_col: str = "text") -> list[str]:
    """The words of the highest count classes that hold at most `most` words together.

    Classes are sixteenths of a doubling, so that the driver gets a histogram of bounded length and then at most
    `most` words, whatever the number of tasks.
    """
    classed = word_counts(docs, text_col).where("n > 1").withColumn("class", F.floor(F.log2("n") * 16).cast("int"))
    classed = written(classed.select("word", "class"), "words")
    cut, room = None, most
    for c, k in sorted(classed.groupBy("class").count().collect(), reverse=True):
        if k > room:
            break
        cut, room = c, room - k
    return [] if cut is None else [r.word for r in classed.where(F.col("class") >= cut).select("word").collect()]


def ship_lexicon(spark: SparkSession, docs: DataFrame, bpe: ByteBpe, lexicon_words: int = 65_536, text_col: str = "text") -> str:
    """Compile the most frequent words and hand the file to the executors; its name there is returned."""
    top = frequent_words(docs, lexicon_words, text_col)
    bpe = bpe.open()
    words = sorted({w.encode() for w in top if len(w) <= 128})
    data = compile_lexicon([(w, bpe.merge(w)) for w in words])
    name = f"lexicon-{uuid.uuid4().hex}"
    spark.sparkContext.addFile(put_bytes(spark, name, data))
    return name


#: Encoders of this worker process by the lexicon's name, the latest only.
_OPEN: dict[str, Encoder] = {}


def _encoder(bpe: ByteBpe, name: str) -> Encoder:
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = Encoder(bpe.open(), Lexicon(SparkFiles.get(name)))
    return _OPEN[name]


def encode(docs: DataFrame, tokenizer: str, lexicon_words: int = 65_536, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each whole text; with_ids and with_text add ids (array) and decoded."""
    spark, bpe = docs.sparkSession, ByteBpe(tokenizer)
    name = ship_lexicon(spark, docs, bpe, lexicon_words, text_col)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(bpe, name)
        for batch in batches:
            columns: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for text in batch.column("text"):
                ids = encoder.encode(text.as_py() or "")
                back = encoder.bpe.decode(ids)
                columns["n_tokens"].append(len(ids) // 4)
                columns["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                columns["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    columns["ids"].append(np.frombuffer(ids, "<u4").astype("int32"))
                if with_text:
                    columns["decoded"].append(back)
            arrays = [batch.column("id"), pa.array(columns["n_tokens"], pa.int64()), pa.array(columns["ids_sha256"], pa.string()), pa.array(columns["decoded_sha256"], pa.string())]
            arrays += [pa.array(columns["ids"], pa.list_(pa.int32()))] * with_ids + [pa.array(columns["decoded"], pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text])

    kind = slim.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return slim.mapInArrow(run, schema)


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded: the text of each array of ids; null counts as empty."""
    bpe = ByteBpe(tokenizer)
    slim = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = bpe.open()
        for batch in batches:
            texts = [tables.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "decoded"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, decoded string")
