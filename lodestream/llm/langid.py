"""Language identification with interpolated Kneser-Ney character models.

* A text is split at white space; each piece gives its runs of letters in lower case, and each run is scored as a
  sequence of characters between boundary marks, also those beside digits. Models don't look across words, so that a
  word has one score in each language, which a worker remembers.
* For each language: counts of character n-grams of the highest order; continuation counts (distinct characters
  before) below; one discount an order, n1 / (n1 + 2 n2); interpolation down to a uniform distribution.
* Models are arrays of 64-bit n-gram hashes in order, searched by bisection, with log probabilities beside them, and
  context hashes with back-off weights.
* The language of least cross-entropy per character wins (ties: the first in code-point order). Its score is its
  posterior from the length-normalised cross-entropies, with a scale that is fitted on held-back training documents.
* Rejection: a text is rejected if it has no letters, or if its least cross-entropy lies too far above what its
  language's own texts have. The distance is measured in deviations that shrink with the text's length (a document
  part and a character part, both fitted), so that short texts aren't rejected for being short. The limit is calibrated
  on held-back documents, of which it rejects at most the share `false_rejections`, and on negatives made from them:
  their words with letters shuffled, random strings over their letters, and their texts under models of other
  languages only. Between the two it lies halfway. `Identifier.rates` holds the measured rate on each of them.

Fitting takes at most `most_docs` documents a language, those least by hash of id, so that models have a bounded size;
each language's arrays are built by one task, from that sample. Every document is scored on its whole text.

Defined results
* null or letterless texts: language `und`, score 0, rejected.
* documents with a null language, or a null id, are never learned from. Without any training documents all are `und`.
* rows that repeat an id are scored alike. Other columns are carried by `accepted` and never looked at.
"""

from __future__ import annotations

import pickle
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.llm.minhash import mixed
from lodestream.session import written

UNKNOWN = "und"
#: Stands before and after a run of letters.
MARK = "\x02"
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
#: Pieces, and characters in them, whose scores a worker remembers before it starts anew.
MEMO, MEMO_CHARS = 400_000, 20_000_000
#: Rows (id, language) of the training sample up to which it is broadcast.
BROADCAST_ROWS = 500_000


def ngram_hash(codes: np.ndarray, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hash of the `length` characters that end before `at`."""
    n = int(np.max(length)) if len(at) else 0
    x = (np.zeros(len(at), np.uint64) + np.asarray(length, np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(n, 0, -1):
        use = k <= np.asarray(length)
        c = codes[np.maximum(at - k, 0)].astype(np.uint64)
        step = (x ^ c) * np.uint64(0x9E3779B97F4A7C15)
        x = np.where(use, step ^ (step >> np.uint64(29)), x)
    return mixed(x)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class CharModel:
    """One language's model; arrays only, so that it travels well."""

    def __init__(self, counts: dict[str, int], order: int):
        """counts: n-grams of the highest order (shorter at a run's start, beginning with its mark)."""
        self.order = order
        level: dict[str, int] = dict(counts)
        by_order: list[dict[str, int]] = [{} for _ in range(order + 1)]
        for gram, n in level.items():
            by_order[len(gram)][gram] = by_order[len(gram)].get(gram, 0) + n
        for k in range(order, 1, -1):  # continuation counts; grams that begin with the mark have no shorter history
            for gram in by_order[k]:
                if gram[1:]:
                    by_order[k - 1][gram[1:]] = by_order[k - 1].get(gram[1:], 0) + 1
        self.alphabet = max(2, len(by_order[1]) + 1)
        probability: dict[str, float] = {"": 1 / self.alphabet}
        backoff: dict[str, float] = {}
        for k in range(1, order + 1):
            grams = by_order[k]
            n1, n2 = sum(c == 1 for c in grams.values()), sum(c == 2 for c in grams.values())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total: Counter[str] = Counter()
            kinds: Counter[str] = Counter()
            for gram, c in grams.items():
                total[gram[:-1]] += c
                kinds[gram[:-1]] += 1
            for context in total:
                backoff[context] = d * kinds[context] / total[context]
            for gram, c in grams.items():
                probability[gram] = (c - d) / total[gram[:-1]] + backoff[gram[:-1]] * probability[gram[1:]]
        self.base = float(np.log(probability.pop("")))
        self.grams, self.logs = self._table(probability)
        self.contexts, self.weights = self._table(backoff)

    @staticmethod
    def _table(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        keys, logs = np.zeros(len(values), np.uint64), np.zeros(len(values), np.float32)
        for size in {len(k) for k in values}:
            own = [(i, k) for i, k in enumerate(values) if len(k) == size]
            if size:
                codes = _codes("".join(k for _, k in own))
                keys[[i for i, _ in own]] = ngram_hash(codes, np.arange(1, len(own) + 1) * size, size)
            else:
                keys[own[0][0]] = ngram_hash(np.zeros(1, np.uint32), np.zeros(1, np.int64), 0)[0]
        logs[:] = np.log(np.fromiter(values.values(), float, len(values)))
        order = np.argsort(keys)
        return keys[order], logs[order]

    def scores(self, hashes: list[np.ndarray], contexts: list[np.ndarray], longest: np.ndarray) -> np.ndarray:
        """Log probability of each character; hashes[k], contexts[k]: of its n-gram of k characters and of that without it."""
        out = np.zeros(len(longest))
        left = np.arange(len(longest))
        for k in range(self.order, 0, -1):
            now = left[longest[left] >= k]
            at = np.minimum(np.searchsorted(self.grams, hashes[k][now]), len(self.grams) - 1)
            hit = self.grams[at] == hashes[k][now]
            out[now[hit]] += self.logs[at[hit]]
            miss = now[~hit]
            at = np.minimum(np.searchsorted(self.contexts, contexts[k][miss]), len(self.contexts) - 1)
            known = self.contexts[at] == contexts[k][miss]
            out[miss[known]] += self.weights[at[known]]
            left = np.concatenate([left[longest[left] < k], miss])
        out[left] += self.base
        return out


class Identifier:
    """Models of several languages with the limits for rejection."""

    def __init__(self, models: dict[str, CharModel], order: int):
        self.languages = sorted(models)
        self.models = [models[x] for x in self.languages]
        self.order = order
        #: Rows a language: usual cross-entropy, its deviation between documents, and that of a single character.
        self.usual = np.tile([0.0, 1.0, 1.0], (len(self.languages), 1))
        self.limit = np.inf
        self.rates: dict[str, float] = {}
        self.scale = 20.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "memory", "chars")}

    def piece_scores(self, pieces: list[str]) -> np.ndarray:
        """A row for each piece: log probability of its letters in each language, then the number of characters scored."""
        runs, owner = [], []
        for i, piece in enumerate(pieces):
            for run in _LETTERS.findall(piece):
                runs.append(run.lower())
                owner.append(i)
        out = np.zeros((len(pieces), len(self.languages) + 1))
        if not runs:
            return out
        codes = _codes(MARK + MARK.join(runs) + MARK)
        size = np.fromiter(map(len, runs), np.int64, len(runs)) + 1
        of = np.repeat(np.array(owner), size)
        begin = np.repeat(np.cumsum(size) - size, size)
        at = np.arange(1, len(codes))  # the mark that ends a run begins the next one
        longest = np.minimum(at - begin + 1, self.order)
        hashes = [None] + [ngram_hash(codes, at + 1, k) for k in range(1, self.order + 1)]
        contexts = [None] + [ngram_hash(codes, at, k - 1) for k in range(1, self.order + 1)]
        for k, model in enumerate(self.models):
            out[:, k] = np.bincount(of, model.scores(hashes, contexts, longest), len(pieces))
        out[:, -1] = np.bincount(of, minlength=len(pieces))
        return out

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: cross-entropy per character in each language, infinite without letters; then the characters scored.

        The pieces of a batch that the worker doesn't remember are scored together.
        """
        memo: dict[str, int] = self.__dict__.setdefault("memo", {})
        if len(memo) > MEMO or self.__dict__.get("chars", 0) > MEMO_CHARS:
            memo.clear()
        if not memo:
            self.chars, self.memory = 0, np.zeros((0, len(self.languages) + 1), np.float32)
        split = [(t or "").split() for t in texts]
        fresh = list({p for pieces in split for p in pieces if p not in memo})
        self.chars += sum(map(len, fresh))
        memo.update(zip(fresh, range(len(memo), len(memo) + len(fresh))))
        rows = [self.piece_scores(fresh[k : k + 20_000]).astype(np.float32) for k in range(0, len(fresh), 20_000)]
        self.memory = np.concatenate([self.memory, *rows])
        out = np.full((len(texts), len(self.languages) + 1), np.inf)
        out[:, -1] = 0
        for i, pieces in enumerate(split):
            total = self.memory[np.fromiter(map(memo.__getitem__, pieces), np.int64, len(pieces))].sum(0, dtype=float)
            if total[-1]:
                out[i, :-1] = -total[:-1] / total[-1]
                out[i, -1] = total[-1]
        return out

    def distance(self, h: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many deviations cross-entropies h of n characters lie above what is usual for the languages `best`."""
        usual, between, single = self.usual[best].T
        return (h - usual) / np.sqrt(between**2 + single**2 / np.maximum(n, 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, least cross-entropy and rejection of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.inf), np.ones(len(texts), bool)
        h = self.entropies(texts)
        h, n = h[:, :-1], h[:, -1]
        has = np.isfinite(h[:, 0]) & np.array([t is not None and bool(_LETTER.search(t)) for t in texts], bool)
        best = np.where(has, h.argmin(1), 0)
        least = np.where(has, h[np.arange(len(h)), best], np.inf)
        gap = np.where(has[:, None], h - np.where(has, least, 0)[:, None], 0)
        score = np.where(has, 1 / np.exp(-self.scale * gap).sum(1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has)], score, least, ~has | (self.distance(least, best, n) > self.limit)


def learned_from(id_col: str) -> F.Column:
    """Whether the fold that models may see holds a document: crc32 of its id as text modulo 4 isn't 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def sample_of(keys: DataFrame, most_docs: int) -> DataFrame:
    """id, lang, r: for each language the `most_docs` rows (id, lang) least by hash of id, numbered from 1.

    Of a language with more, only rows whose hash lies in a leading part that holds about four times as many are
    ranked (the chance that it holds too few is below e^-1000), so that no task orders a whole language.
    """
    keys = keys.withColumn("h", F.xxhash64("id"))
    totals = written(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    some = totals.withColumn("upto", F.least(F.lit(1.0), F.lit(4.0 * most_docs + 100) / F.col("n"))).select("lang", "upto")
    near = (F.col("h").cast("double") / 2.0**64 + 0.5) <= F.col("upto")
    leading = keys.join(F.broadcast(some) if totals.count() <= BROADCAST_ROWS else some, "lang").where(near)
    return leading.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "id"))).where(F.col("r") <= most_docs).select("id", "lang", "r")


def fit(docs: DataFrame, order: int = 4, most_docs: int = 1500, held_back: int = 10, false_rejections: float = 0.002, least_count: int = 1) -> Identifier:
    """An identifier from rows (id, text, lang), of which the caller has removed those not to be learned from.

    One in `held_back` documents of the sample sets limit and scale. n-grams are counted in the tasks and summed by
    Spark, each language's arrays are built from the sums by one task, and the driver gets the arrays.
    """
    keys = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull()).select("id", "lang")
    chosen = sample_of(keys, most_docs).select("id", "lang", (F.col("r") % held_back == 0).alias("back"))
    chosen = written(chosen, "sample")
    small = chosen.count() <= BROADCAST_ROWS  # so many languages that it isn't: let both sides be shuffled
    sample = docs.select("id", "text").join(F.broadcast(chosen) if small else chosen, "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                own = found.setdefault(lang, Counter())
                for run in _LETTERS.findall(text):
                    run = MARK + run.lower() + MARK
                    own.update(run[max(0, e - order) : e] for e in range(2, len(run) + 1))
        for lang, own in found.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(own), pa.string()), "gram": pa.array(own.keys(), pa.string()), "n": pa.array(own.values(), pa.int64())})

    def build(table: pa.Table) -> pa.Table:
        model = CharModel(dict(zip(table.column("gram").to_pylist(), table.column("n").to_pylist())), order)
        return pa.table({"lang": table.column("lang")[:1], "model": pa.array([pickle.dumps(model)], pa.binary())})

    grams = sample.where(~F.col("back")).select("text", "lang").mapInArrow(count, "lang string, gram string, n long")
    sums = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    models = {r.lang: pickle.loads(r.model) for r in sums.groupBy("lang").applyInArrow(build, "lang string, model binary").collect()}
    identifier = Identifier(models, order)
    if models:
        _calibrate(identifier, sample.where("back").select("text", "lang"), false_rejections)
    return identifier


def negatives(text: str, seed: int = 0) -> dict[str, str]:
    """Texts of no language from one of a language: its letters shuffled within words, and drawn at random."""
    draw = random.Random(f"{seed}:{len(text)}:{text[:50]}")
    letters = sorted(set("".join(_LETTERS.findall(text.lower())))) or ["x"]
    shuffled = lambda m: "".join(draw.sample(m[0], len(m[0])))
    return {"shuffled": _LETTERS.sub(shuffled, text), "random": _LETTERS.sub(lambda m: "".join(draw.choices(letters, k=len(m[0]))), text)}


def _calibrate(identifier: Identifier, held: DataFrame, false_rejections: float) -> None:
    """Limit and scale from documents that the models haven't seen; the driver gets a few numbers for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                kinds = {"own": text, **negatives(text)}
                h = identifier.entropies(list(kinds.values()))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(kinds.keys()), pa.array(h.tolist(), pa.list_(pa.float64()))], names=["lang", "kind", "h"])

    rows = held.mapInArrow(run, "lang string, kind string, h array<double>").toArrow()
    every = np.array(rows.column("h").to_pylist(), float).reshape(rows.num_rows, len(identifier.languages) + 1)
    names = {x: k for k, x in enumerate(identifier.languages)}
    truth = np.array([names.get(x, -1) for x in rows.column("lang").to_pylist()], int)
    kind = np.array(rows.column("kind").to_pylist(), str)
    usable = (truth >= 0) & np.isfinite(every).all(1)
    own = usable & (kind == "own")
    h, n, of = every[own, :-1], every[own, -1], truth[own]
    right = h.argmin(1) == of
    for k in range(len(identifier.languages)):
        x, m = h[right & (of == k), k], n[right & (of == k)]
        if len(x) > 1:
            # squared residuals are about between^2 + single^2 / n: a least-squares line through them, without outliers
            centre = float(np.median(x))
            square = np.minimum((x - centre) ** 2, np.quantile((x - centre) ** 2, 0.98))
            slope = np.polyfit(1 / m, square, 1) if len(set(m)) > 2 else (0.0, float(square.mean()))
            identifier.usual[k] = centre, max(np.sqrt(max(slope[1], 0.0)), 1e-2), np.sqrt(max(slope[0], 0.0))
    if not right.any():
        return
    far = identifier.distance(h[right, of[right]], of[right], n[right])
    unlike = {}
    for name in ("shuffled", "random"):
        some = every[usable & (kind == name)]
        best = some[:, :-1].argmin(1)
        unlike[name] = identifier.distance(some[np.arange(len(some)), best], best, some[:, -1])
    if len(identifier.languages) > 1:
        other = h.copy()
        other[np.arange(len(h)), of] = np.inf
        best = other.argmin(1)
        unlike["foreign"] = identifier.distance(other[np.arange(len(h)), best], best, n)
    low = float(np.quantile(far, 1 - false_rejections))
    high = float(np.quantile(np.concatenate(list(unlike.values())), 0.05))
    identifier.limit = max(low, (low + high) / 2)
    identifier.rates = {"own": float((far > identifier.limit).mean()), **{k: float((x > identifier.limit).mean()) for k, x in unlike.items()}}

    def loss(scale: float) -> float:
        z = -scale * h
        z -= z.max(1, keepdims=True)
        return float(-(z[np.arange(len(z)), of] - np.log(np.exp(z).sum(1))).mean())

    identifier.scale = min((2.0**k for k in range(-1, 9)), key=loss)


def identify(docs: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, cross_entropy (null without letters), rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, least, out = shared.value.predict(batch.column("text").to_pylist())
            arrays = [batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([x if np.isfinite(x) else None for x in least], pa.float64()), pa.array(out, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "lang_pred", "score", "cross_entropy", "rejected"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return docs.where(learned_from(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def accepted(docs: DataFrame, identifier: Identifier | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that aren't rejected, with all their columns; models are fitted on the table unless given."""
    identifier = identifier or fit(training_rows(docs, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = shared.value.predict(batch.column(batch.schema.names.index(text_col)).to_pylist())[3]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
