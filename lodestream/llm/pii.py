"""Personal data by fixed patterns, extended by bootstrapped contextual extraction.

1. Base: four kinds of spans by fixed patterns with checks of their digits (`base_spans`). They seed the rest. A fifth
   kind, secret, has no pattern of its own: runs of 32 or more hexadecimal digits are its seeds, which alone are no
   proof (a digest looks alike) and become spans only where a pattern is trusted.
2. Patterns: what stands beside an identifier on its line, in lexical form: one, two or three words before it with the
   punctuation up to it, or one or two words after it with the punctuation between, for a kind. They are taken at seeds
   and at other tokens of a make that the kind could have (instances to be judged).
3. Scoring, in Spark over the whole graph of patterns and instances: a pattern's confidence is the smoothed share of
   confidence among its distinct instances; an instance's is the complement of all its patterns being wrong. Seeds
   keep confidence 1. A fixed number of rounds, each two aggregations.
4. Lift: patterns with enough distinct seeds and confidence are looked for in all texts. Only those stay beside which
   an identifier stands in at least `least_share` of all occurrences, and at least `least_lift` times as often as
   beside any word; a phrase of ordinary prose tells nothing, however many identifiers it happens to precede.
5. Trusted patterns mark their other instances as spans of their kind, of seeds of a secret too.

Base spans always stay; a discovered span never overlaps one. Every text is read whole; only spans and contexts are
shuffled. Candidate patterns stay in tables; their sides are looked for in scans of about `scan_sides` each, which is what
goes through the driver at once. No pattern is left out for being one of many.

Limits of what contexts discover: up to SIDE code points of a line on either side of a token are looked at, and tokens
have the lengths that `_TOKEN`, `_AT` and `_SECRET` state; identifiers written in longer forms are never discovered.

Defined results
* null texts count as empty; a text without finds has zero counts, an empty span list and the digest of the empty string.
* rows that repeat an id each get their own spans; ids may be null.
* of discovered spans that overlap, the one whose pattern has more confidence stays (ties: the first, then the longer).
* an empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import written

KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of spans with one start; the last is found by contexts only.
ALL_KINDS = (*KINDS, "secret")
#: Fixed patterns of the base; the look-behind only spares starts within a run of digits, where no match can begin.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Identifier-like tokens of the makes that a pattern of a kind can reveal, and the context on either side.
_TOKEN = re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9 .()-]{4,30}[0-9](?![0-9A-Za-z])")
_AT = re.compile(r"[A-Za-z0-9._%+-]{2,64}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{2,64}(?: ?[\[(]dot[\])] ?|\.| dot )[A-Za-z]{2,10}")
#: Tokens that could be secrets, and those that seed the kind. They mix letters and digits.
_SECRET, _SEED = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}"), re.compile(r"[0-9a-fA-F]{32,}")
#: A word with the punctuation after it, which must reach the token: up to SIDE code points of a line are looked at.
_WORD = re.compile(r"([^\W\d_]+)([^\w\n]{0,6})")
_AFTER = re.compile(r"([^\w\n]{0,4})((?:[^\W\d_]+[^\w\n]{1,2}){0,2})")
SIDE = 80


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: a run before it can match at its first character or not at all."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _make(kind: str, token: str) -> bool:
    """Whether a token that isn't a base span could be an identifier of a kind, written otherwise."""
    digits = _digits(token)
    if kind == "ip":
        parts = re.split("[ .-]+", token)
        return len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 7 <= len(digits) <= 15


def _squeezed(s: str) -> str:
    return " ".join(s.lower().split(" ")) if "  " not in s else re.sub(" +", " ", s.lower())


def sides(text: str, start: int, end: int) -> Iterator[str]:
    """The patterns' sides at a token: `<` and up to three words before it, `>` and up to two after it, punctuation included."""
    before = text[max(0, start - SIDE) : start].rpartition("\n")[2]
    words = [m for m in _WORD.finditer(before)]
    tail, k = len(before), 0
    while words and k < 3 and words[-1].end() == tail:
        if words[-1].start() == 0 and start > SIDE and len(before) == SIDE:
            break  # may begin within a word
        tail, k = words.pop().start(), k + 1
        yield "<" + _squeezed(before[tail:])
    after = _AFTER.match(text, end, end + SIDE)
    parts = re.findall(r"[^\W\d_]+[^\w\n]{1,2}", after[2])
    for k in range(1, len(parts) + 1):
        yield ">" + _squeezed(after[1] + "".join(parts[:k]))


def contexts(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, str, bool, int, int]]:
    """(pattern, instance, seed, start, end) at base spans and at identifier-like tokens clear of them; a pattern is kind and side."""
    for kind, start, end in base:
        for side in sides(text, start, end):
            yield kind + side, text[start:end], True, start, end
    begins, reach = [s for _, s, _ in base], list(accumulate((e for _, _, e in base), max))
    for regex, kinds in ((_TOKEN, ("ip", "card", "phone")), (_AT, ("email",)), (_SECRET, ("secret",))):
        for m in regex.finditer(text):
            start, end = m.span()
            if kinds == ("secret",) and not (any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])):
                continue
            before_end = bisect_left(begins, end)
            if before_end and reach[before_end - 1] > start:
                continue
            made = [k for k in kinds if k in ("email", "secret") or _make(k, m[0])]
            for side in sides(text, start, end) if made else ():
                for kind in made:
                    yield kind + side, m[0], kind == "secret" and bool(_SEED.fullmatch(m[0])), start, end


def found(docs: DataFrame) -> DataFrame:
    """row, id, the base columns and contexts of rows (id, text)."""
    context = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, around = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                bases.append(base)
                around.append([dict(zip(("pattern", "instance", "seed", "start", "end"), c)) for c in contexts(text, base)])
            joined = [",".join(f"{k}:{s}:{e}" for k, s, e in base) for base in bases]
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base in bases], pa.int64()) for kind in KINDS]
            arrays = [batch.column("id"), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()), pa.array(joined, pa.string()), pa.array(around, context)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "contexts"])

    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, contexts array<struct<pattern:string,instance:string,seed:boolean,start:bigint,end:bigint>>"
    return docs.mapInArrow(run, schema)


def scored_patterns(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """pattern, confidence, seeds from edges (pattern, instance, seed).

    Each round joins the edges with the confidences of instances and of patterns; the graph holds distinct edges, so
    that an instance which very many documents repeat counts once for a pattern. Patterns with a single instance can
    neither be trusted nor tell anything of it, and aren't kept in the graph.
    """
    edges = edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    several = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.upper("pattern").alias("key"), F.col("pattern").alias("p"))
    edges = written(edges.join(several.hint("merge"), (F.upper("pattern") == F.col("key")) & (F.col("pattern") == F.col("p")), "left_semi"), "edges")
    scored = edges.withColumn("belief", F.col("seed").cast("double"))
    for turn in range(rounds):
        patterns = scored.groupBy("pattern").agg((F.sum("belief") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.sum(F.col("seed").cast("long")).alias("seeds"))
        patterns = written(patterns, "patterns")
        if turn == rounds - 1:
            return patterns
        doubt = F.log1p(-F.least("confidence", F.lit(0.999)))
        linked = edges.join(patterns.select(F.upper("pattern").alias("key"), F.col("pattern").alias("p"), "confidence"), (F.upper("pattern") == F.col("key")) & (F.col("pattern") == F.col("p")))
        instances = linked.groupBy("instance").agg((1 - F.exp(F.sum(doubt))).alias("by_patterns"))
        scored = edges.join(instances, "instance").withColumn("belief", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("by_patterns")))


def occurrences(docs: DataFrame, wanted: list[str]) -> tuple[DataFrame, int]:
    """(side, n: how often it occurs in all texts of rows (id, text); the number of words); one scan with an automaton.

    A side counts where it stands as `sides` would cut it: from the start of a word, or up to the end of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for k, side in enumerate(wanted):
            held = automaton.get(side[1:], [])
            automaton.add_word(side[1:], held + [k])
        automaton.make_automaton()
        found, words = [0] * len(wanted), 0
        for batch in batches:
            for value in batch.column("text"):
                text = _squeezed(value.as_py() or "")
                words += text.count(" ") + 1
                for last, ks in automaton.iter(text):
                    for k in ks:
                        first = last - len(wanted[k]) + 2
                        if wanted[k][0] == ">" or first == 0 or not text[first - 1].isalpha():
                            found[k] += 1
        yield pa.RecordBatch.from_pydict({"side": pa.array([*wanted, None], pa.string()), "n": pa.array([*found, words], pa.int64())})

    sums = written(docs.select("text").mapInArrow(run, "side string, n long").groupBy("side").agg(F.sum("n").alias("n")), "occurrences")
    words = sums.where("side is null").collect()
    return sums.where("side is not null"), words[0].n if words else 0


def trusted_patterns(
    docs: DataFrame, edges: DataFrame, rounds: int = 3, least_seeds: int = 5, least_confidence: float = 0.6, least_share: float = 0.3, least_lift: float = 20.0, scan_sides: int = 20_000
) -> DataFrame:
    """pattern, confidence of those that may discover: rows (id, text) and edges (row, pattern, instance, seed, start).

    Every pattern that is sure enough is judged by how its side occurs in all texts. A scan looks for about scan_sides
    sides, which is what the driver and a worker's automaton hold; more sides take more scans.
    """
    spark = docs.sparkSession
    scored = scored_patterns(edges.select("pattern", "instance", "seed"), rounds)
    side = F.regexp_extract("pattern", "(?s)[<>].*", 0)  # kinds hold neither sign
    able = scored.where((F.col("seeds") >= least_seeds) & (F.col("confidence") >= least_confidence)).select("pattern", "confidence", side.alias("side"))
    able = written(able, "able-patterns")
    sides = able.select("side").distinct()
    scans = -(-sides.count() // scan_sides)
    counts, words = spark.createDataFrame([], "side string, n long"), 0
    for scan in range(scans):
        wanted = sorted(r.side for r in sides.where(F.pmod(F.xxhash64("side"), F.lit(scans)) == scan).collect())
        if wanted:
            here, words = occurrences(docs, wanted)
            counts = counts.unionByName(here)
    tokens = edges.select("row", "start").distinct().count() if scans else 0
    base = tokens / max(1, words)
    beside = edges.join(able.select("pattern"), "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("beside"))
    share = F.col("beside") / F.greatest(F.col("n"), F.lit(1))
    judged = able.join(beside, "pattern").join(counts, "side").withColumn("share", share)
    return written(judged.where((F.col("share") >= least_share) & (F.col("share") >= least_lift * base)).select("pattern", "confidence"), "trusted-patterns")


def clear_spans(found: list[dict]) -> list[dict]:
    """Of spans in the order of their doubt, those that are clear of what has been taken before them."""
    begins, ends, out = [], [], []
    for x in found:
        k = bisect_left(begins, x["end"])  # taken spans don't overlap, so the one before is the only one to look at
        if x["start"] < x["end"] and not (k and ends[k - 1] > x["start"]):
            begins.insert(k, x["start"])
            ends.insert(k, x["end"])
            out.append({"start": x["start"], "end": x["end"], "kind": x["kind"]})
    return out


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every row; spans are base and discovered ones."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(found(slim).withColumn("row", F.monotonically_increasing_id()), "finds")
    edges = rows.select("row", F.explode("contexts").alias("c")).select("row", "c.*")
    trusted = trusted_patterns(slim, edges, **options).select(F.upper("pattern").alias("key"), F.col("pattern").alias("own"), "confidence")
    kind = F.regexp_extract("pattern", "^([a-z]+)", 1)
    open_ones = edges.where(~F.col("seed") | F.col("pattern").startswith("secret"))
    new = open_ones.join(trusted, (F.upper("pattern") == F.col("key")) & (F.col("pattern") == F.col("own")))
    new = new.groupBy("row", "start", "end").agg(F.max("confidence").alias("confidence"), F.max_by(kind, F.struct("confidence", "pattern")).alias("kind"))
    new = new.groupBy("row").agg(F.collect_list(F.struct((-F.col("confidence")).alias("doubt"), "start", (F.col("start") - F.col("end")).alias("short"), "end", "kind")).alias("new"))

    @F.pandas_udf("array<struct<start:bigint,end:bigint,kind:string>>")
    def apart(spans: pd.Series) -> pd.Series:
        return spans.map(clear_spans)

    # the surest first, then those that are clear of what has been taken
    new = new.select("row", apart(F.array_sort("new")).alias("new"))

    def parsed(span: F.Column) -> F.Column:
        parts = F.split(span, ":")
        return F.struct(parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"), parts[0].alias("kind"))

    def ordered(spans: F.Column) -> F.Column:
        order = F.array(*[F.lit(k) for k in ALL_KINDS])
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.transform(F.split("base", ","), parsed)
    both = F.when(F.col("base") == "", F.col("new")).otherwise(F.concat(base, F.col("new")))
    spans = F.when(F.col("new").isNull(), F.col("base")).otherwise(ordered(both))
    out = rows.join(new, "row", "left").select("id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"))
    return out.withColumn("n_spans", F.when(F.col("spans") == "", 0).otherwise(F.regexp_count("spans", F.lit(",")) + 1).cast("long"))
