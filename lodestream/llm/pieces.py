"""SentencePiece encoding and decoding of whole texts for merge-type (BPE) vocabularies.

A text's code points are the first symbols. An agenda holds the adjacent pairs of symbols whose concatenation is a piece,
the highest score first and of equal scores the leftmost; the first is merged, its new neighbours enter, until none is
left. Symbols that are no pieces fall back to the pieces of their bytes.

Merges never cross a place that no piece spans, so a text is cut there first (before the mark of a space, if no piece
holds one after another character, and around ASCII characters that no longer piece holds) and each chunk has an agenda
of its own. A bounded memo in each worker holds the chunks that it has met; longer chunks aren't kept.

With `check`, each Arrow batch is also encoded and decoded by the sentencepiece library, and a text on which the two
differ fails the job: a result that was returned is known to be the library's.

Defined results
* null and empty texts have no tokens; both digests are then those of the empty string.
* strings that look like control or byte pieces (<s>, <0x41>) are plain text, as in the library.
* models with another normaliser than identity, with user-defined or unused pieces or of another type are refused.
* repeated rows are encoded alike; null ids are carried; other columns are never looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a space, and the surface of the unknown piece's default (fixed values).
SPACE = "▁"
#: Letters after which a text may be cut, as a range for expressions.
LETTERS = "A-Za-z\u00c0-\u024f"
#: Kinds of pieces in model files (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Chunks that a worker remembers at most, and their length.
MEMO, MEMO_LENGTH = 1_600_000, 128
#: An agenda entry is one integer: rank of the score, then place of the left symbol, then code points of the piece.
PLACE, LENGTH = 8, 56
#: Up to this length a list is searched faster than a heap is kept; and the entry of a pair that is no piece.
SHORT, NEVER = 40, 1 << 80

#: A byte that starts no valid character becomes one U+FFFD, and reading goes on with the next byte.
codecs.register_error("lodestream_each_byte", lambda e: ("�", e.start + 1))


class Pieces:
    """A merge-type vocabulary from a sentencepiece model file. Objects travel to the workers by pickle."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = f.read()
        self.open()

    def __getstate__(self) -> dict:
        return {"model": self.model}

    def open(self) -> Pieces:
        """Build the tables for use; cheap enough for once a worker."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(self.model)
        trainer, normal = proto.trainer_spec, proto.normalizer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("this operator reads merge-type models with byte fallback")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("normalisers other than identity aren't supported")
        if {p.type for p in proto.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE} or any(len(p.piece) > 255 for p in proto.pieces):
            raise ValueError("user-defined, unused and very long pieces aren't supported")
        self.prefix = " " if normal.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.id = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        ranks = {s: k for k, s in enumerate(sorted({p.score for p in proto.pieces if p.type == NORMAL}, reverse=True))}
        self.rank = {p.piece: ranks[p.score] for p in proto.pieces if p.type == NORMAL}
        self.entry = {p.piece: ranks[p.score] << LENGTH | len(p.piece) for p in proto.pieces if p.type == NORMAL}
        self.byte_id = [0] * 256
        for k, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = k
        self.byte_of = {k: bytes([b]) for b, k in enumerate(self.byte_id)}
        self.unknown_surface = trainer.unk_surface
        self.chunks = re.compile(self._pattern()).findall
        return self

    def _pattern(self) -> str:
        """What a chunk is: texts are cut where no piece spans, told by the pairs of characters within pieces.

        That is before a space after another character, around ASCII characters that no longer piece holds, and between
        a letter of LETTERS and ASCII punctuation that follows none in any piece. Spaces stand for their marks here.
        """
        longer = [p.replace(SPACE, " ") for p in self.id if len(p) > 1]
        pairs = {(a, b) for p in longer for a, b in zip(p, p[1:])}
        if any(b == " " and a != " " for a, b in pairs):
            return r"(?s:.+)"
        held, letter = set("".join(longer)), re.compile(f"[{LETTERS}]")
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in held and c != 0x20)
        follow = {b for a, b in pairs if letter.match(a)}
        breaks = "".join(re.escape(chr(c)) for c in range(0x21, 0x7F) if not letter.match(chr(c)) and chr(c) in held and chr(c) not in follow)
        rest = rf"[^ {alone}{LETTERS}]*[{LETTERS}]*"
        return (rf"[{alone}]|(?=[^{alone}])" if alone else r"(?=[\s\S])") + rf" *{rest}(?:[^ {alone}{LETTERS}{breaks}]{rest})*"

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk by the agenda of adjacent pairs; a short chunk's agenda is a list in the order of places."""
        symbols, entry, n = list(chunk.replace(" ", SPACE)), self.entry.get, len(chunk)
        if n <= SHORT:
            entry = self.rank.get
            agenda = [entry(pair, NEVER) for pair in map(str.__add__, symbols, symbols[1:])]
            while agenda and (best := min(agenda)) < NEVER:
                i = agenda.index(best)
                symbols[i] = left = symbols[i] + symbols[i + 1]
                del agenda[i], symbols[i + 1]
                if i:
                    agenda[i - 1] = entry(symbols[i - 1] + left, NEVER)
                if i < len(agenda):
                    agenda[i] = entry(left + symbols[i + 1], NEVER)
            return self.ids_of(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [e + (i << PLACE) for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if (e := entry(pair))]
        heapq.heapify(agenda)
        while agenda:
            e = heapq.heappop(agenda)
            i = e >> PLACE & (1 << LENGTH - PLACE) - 1
            j = after[i]
            left = symbols[i]
            if not left or j >= n or len(left) + len(symbols[j]) != e & 255:
                continue  # one of the two has been merged since
            symbols[i] = left = left + symbols[j]
            symbols[j], after[i] = "", (k := after[j])
            if k < n:
                before[k] = i
                if e := entry(left + symbols[k]):
                    heapq.heappush(agenda, e + (i << PLACE))
            if (h := before[i]) >= 0 and (e := entry(symbols[h] + left)):
                heapq.heappush(agenda, e + (h << PLACE))
        return self.ids_of(symbols)

    def ids_of(self, symbols: list[str]) -> list[int]:
        """Ids of symbols, those that aren't pieces by the pieces of their bytes."""
        ids: list[int] = []
        for s in symbols:
            if s:
                k = self.id.get(s)
                ids += [k] if k is not None else [self.byte_id[b] for b in s.encode()]
        return ids

    def surface(self, ids: list[int]) -> bytes:
        """What pieces from an encoding stand for, the leading mark included."""
        return b"".join(self.byte_of[k] if k in self.byte_of else self.pieces[k].replace(SPACE, " ").encode() for k in ids)

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: controls vanish, unknown ones have their surface, runs of bytes are read as UTF-8."""
        out, run, leading, seen = [], b"", bool(self.prefix), False
        for k in ids:
            if self.kinds[k] == BYTE:
                run += self.byte_of[k]
                continue
            if run:
                out.append(run.decode("utf-8", "lodestream_each_byte"))
                run = b""
            leading = leading and not seen and not any(out)
            if self.kinds[k] == CONTROL:
                text, seen = "", False
            elif self.kinds[k] == UNKNOWN:
                text, seen = self.unknown_surface, False
            else:
                text = self.pieces[k]
                seen = leading and text.startswith(SPACE)
                text = text[seen:].replace(SPACE, " ")
            out.append(text)
        return "".join(out) + run.decode("utf-8", "lodestream_each_byte")


class Encoder(dict):
    """Chunk to its ids joined by commas, filled by merging; half of MEMO is dropped at a time.

    A chunk enters when its ids decode to itself, which any encoding does: so the decoded text is that of the chunks.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.before = pieces, {}

    def __missing__(self, chunk: str) -> str:
        found = self.before.get(chunk)
        if found is None:
            ids = self.pieces.merge(chunk)
            if self.pieces.surface(ids) != chunk.encode():
                raise Differs(f"ids of {chunk!r} decode to another text")
            found = ",".join(map(str, ids))
            if len(chunk) > MEMO_LENGTH:
                return found
        if len(self) >= MEMO // 2:
            self.before = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def encode(self, text: str) -> tuple[str, int, str]:
        """Decimal ids joined by commas, their number, and the text that they decode to."""
        if not text:
            return "", 0, ""
        chunks = self.pieces.chunks(self.pieces.prefix + text.replace(SPACE, " "))
        ids, decoded = ",".join(map(self.__getitem__, chunks)), "".join(chunks)
        return ids, ids.count(",") + 1, decoded[len(self.pieces.prefix) :]


class Differs(ValueError):
    """The library encodes or decodes a text otherwise."""


def compare(library, texts: list[str], ids: list[str], decoded: list[str]) -> None:
    """Fail on the first text of a batch for which the library gives other ids or another text."""
    theirs = library.encode(texts, num_threads=1)
    back = library.decode(theirs, num_threads=1)
    for k, text in enumerate(texts):
        if str(theirs[k])[1:-1].replace(" ", "") != ids[k] or back[k] != decoded[k]:
            raise Differs(f"sentencepiece differs on a text of {len(text)} characters that begins with {text[:60]!r}")


#: Encoder and library of this worker process by the model's digest, the latest only.
_OPEN: dict[str, tuple] = {}


def _encoder(pieces: Pieces, check: bool) -> tuple:
    key = f"{hashlib.sha256(pieces.model).hexdigest()} {check}"
    if key not in _OPEN:
        library = None
        if check:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_proto=pieces.model)
        _OPEN.clear()
        _OPEN[key] = (Encoder(pieces.open()), library)
    return _OPEN[key]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each whole text; with_ids and with_text add ids (array) and decoded."""
    pieces = Pieces(model)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, library = _encoder(pieces, check)
        for whole in batches:
            for batch in _bounded(whole):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                found = [encoder.encode(t) for t in texts]
                ids, decoded = [f[0] for f in found], [f[2] for f in found]
                if library:
                    compare(library, texts, ids, decoded)
                columns = {
                    "id": batch.column("id"),
                    "n_tokens": pa.array([f[1] for f in found], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array([[int(k) for k in x.split(",")] if x else [] for x in ids], pa.list_(pa.int32()))
                if with_text:
                    columns["decoded"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    kind = slim.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return slim.mapInArrow(run, schema)


def _bounded(batch: pa.RecordBatch, rows: int = 200) -> Iterator[pa.RecordBatch]:
    """A batch in slices of few rows: ids take many times the memory of their text."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def decode(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded: the text of each array of ids; null counts as empty."""
    pieces = Pieces(model)
    slim = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces.open()
        for batch in batches:
            texts = [tables.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "decoded"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, decoded string")
