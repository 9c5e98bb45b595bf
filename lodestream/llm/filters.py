"""Interaction of five document filters: what each removes in every order, alone, in vain and in fair shares.

A document fails A below 100 words, B if distinct words are under 80 % of its words, C if `[A-Z]` are over 10 % of its
code points, D if it holds any of `#$%&*|`, and E if some row with a smaller id has the identical text.

Duplicates by partition refinement
1. One scan gives each row its length in code points and hashes of its successive blocks (the first 64 code points, the
   next 960, the rest). Only these numbers go on.
2. Rows are split by length, then by one block hash after the other; after each split rows that are alone are dropped.
3. The texts of the rows that are left are read again and compared in full: they are grouped by class and text, equal
   ones being united before the shuffle. A class that holds several texts (equal hashes) is told apart by text.
4. A row whose id isn't its text's least is marked. Filters are then counted as bit masks: at most 32 masks times the
   labels a part, from which all 120 orders follow.

Scale: a text is moved at most once a task, and only if its class may hold another; the filter that decides so is a
bit table in `FILTER_BITS` at most, broadcast. Rows are joined to classes with keys that both sides are dealt by, so
that adaptive execution splits a class that holds a large share of all rows.

Defined results
* null texts are empty: they fail A only, or A and E; equal to each other and to empty texts.
* null ids are smaller than none and none is smaller: such rows never fail E and make no other row fail it. Rows that
  repeat an id and text don't fail E by each other.
* labels count by any of a document's rows in labels; a null id has none. Null languages are the empty string.
* an empty table has no parts and gives no rows; columns besides those named are never looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.session import discard, written

FILTERS = "ABCDE"
#: Ends of the blocks that are hashed, in code points; the last block is the rest of the text.
BLOCK_ENDS = (64, 1024)
#: Most bits of the table that keeps texts out of the shuffle (a bucket of the bitmap functions holds 32,768).
FILTER_BITS = 1 << 27
_BUCKET_BITS = 1 << 15


def _words(text: Column) -> Column:
    """Runs without `[\\x20\\x09-\\x0D]`; split by one plain character, which needs no regular expression."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), lambda w: w != "")


def _blocks(text: Column) -> list[Column]:
    starts = (0, *BLOCK_ENDS)
    sizes = [b - a for a, b in zip(starts, BLOCK_ENDS)] + [2**31 - 1]
    return [F.xxhash64(F.substring(text, a + 1, n)) for a, n in zip(starts, sizes)]


def _slim(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, lang, text, nulls of the last two as empty strings."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _masked(slim: DataFrame, *carried: str | Column) -> DataFrame:
    """id, lang, mask of A to D (bits 0 to 3) and the carried columns."""
    letters = F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    counted = slim.withColumns({"chars": F.length("text").cast("long"), "words": _words(F.col("text")), "others": letters})
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    tests = [
        n < 100,
        F.lit(100) * distinct < F.lit(80) * n,
        F.lit(100) * (F.col("chars") - F.col("others")) > F.lit(10) * F.col("chars"),
        F.length(F.translate("text", "#$%&*|", "")) < F.col("chars"),
    ]
    mask = reduce(lambda a, b: a + b, (F.when(t, F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(tests)))
    return counted.select("id", "lang", mask.alias("mask"), *carried)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hash_bits: int = 64) -> DataFrame:
    """id, lang, mask of A to D (bits 0 to 3) and class_0, class_1, ...: length, then length with ever more block hashes.

    hash_bits below 64 makes classes coarser, for tests of what happens when hashes collide.
    """
    classes = [c.alias(f"class_{k}") for k, c in enumerate(_classes(F.col("text"), hash_bits))]
    return _masked(_slim(docs, id_col, text_col, lang_col), *classes)


def _classes(text: Column, hash_bits: int) -> list[Column]:
    """Class names after each split: the length itself, then hashes of the class before and the next block."""
    out = [F.length(text).cast("long")]
    for block in _blocks(text):
        out.append(F.shiftrightunsigned(F.xxhash64(out[-1], block), 64 - hash_bits))
    return out


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose class another row has too. The join's keys are dealt anew on both sides, so hot ones can be split."""
    several = rows.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(F.bitwise_not(name).alias("other"))
    return rows.join(several.hint("merge"), F.bitwise_not("other") == F.col(name), "left_semi")


def refined(rows: DataFrame) -> DataFrame:
    """Rows of `measured` that share length and all block hashes with another, found split by split."""
    last = len(BLOCK_ENDS) + 1
    alive = rows.select("id", *[f"class_{k}" for k in range(last + 1)])
    for k in range(last + 1):
        before, alive = alive, written(_shared(alive, f"class_{k}"), f"filters-split-{k}")
        discard(before)
    return alive.select("id", F.col(f"class_{last}").alias("class"))


def _may_be(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Texts whose class may be among `classes`, by a bit table of bounded size: it keeps others out of a shuffle."""
    bits = _BUCKET_BITS
    while bits < FILTER_BITS and bits < 16 * classes.count():
        bits *= 2
    place = F.pmod(F.xxhash64("class"), F.lit(bits))
    table = (
        classes.select(place.alias("place")).groupBy(F.expr("bitmap_bucket_number(place)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bitmap"))
    )
    held = texts.withColumn("place", place).withColumn("bucket", F.expr("bitmap_bucket_number(place)"))
    at = F.expr("bitmap_bit_position(place)")
    byte = F.conv(F.hex(F.substring("bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.join(F.broadcast(table), "bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("bucket", "place", "bitmap")


def equal_texts(slim: DataFrame, alive: DataFrame, hash_bits: int = 64) -> DataFrame:
    """class, text, least, n: texts of rows whose class several rows have, compared in full, with their least id."""
    known = slim.where("id is not null").select("id", "text", _classes(F.col("text"), hash_bits)[-1].alias("class"))
    return _may_be(known, alive.select("class").distinct()).groupBy("class", "text").agg(F.min("id").alias("least"), F.count("*").alias("n"))


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hash_bits: int = 64) -> DataFrame:
    """id, lang, mask: the filters that each row fails, A in bit 0 to E in bit 4."""
    slim = _slim(docs, id_col, text_col, lang_col)
    rows = written(measured(docs, id_col, text_col, lang_col, hash_bits), "filters-measured")
    alive = refined(rows)
    groups = equal_texts(slim, alive, hash_bits)
    classes = groups.groupBy("class").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.count("*").alias("texts"))
    classes = written(classes.where("n > 1"), "filters-classes")
    discard(alive)
    again = F.when(F.col("id") > F.col("least"), F.lit(16)).otherwise(F.lit(0))
    out = ["id", "lang", (F.col("mask") + again).cast("int").alias("mask")]

    other = classes.select(F.bitwise_not("class").alias("other"), "least", "texts")
    last = F.col(f"class_{len(BLOCK_ENDS) + 1}")
    joined = rows.join(other.hint("merge"), F.bitwise_not("other") == last, "left")
    if classes.where("texts > 1").isEmpty():
        return joined.select(*out)
    # classes with several texts: a row meets the least id of its own text by the text itself
    mixed = classes.where("texts > 1").select("class")
    own = equal_texts(slim, mixed, hash_bits).select(F.bitwise_not("class").alias("other"), F.col("text").alias("same"), "least")
    texts = slim.withColumn("class", _classes(F.col("text"), hash_bits)[-1]).join(mixed, "class", "left_semi")
    met = texts.join(own.hint("merge"), (F.bitwise_not("other") == F.col("class")) & (F.col("same") == F.col("text")), "left")
    return joined.where("texts is null or texts = 1").select(*out).unionByName(_masked(met, "least").select(*out))


def cells(flags: DataFrame, labels: DataFrame, label_id: str = "doc_id", good: Column | None = None, toxic: Column | None = None) -> DataFrame:
    """part, mask, n, good, toxic: documents of each language that fail the same filters, and how many have each label."""
    good = F.col("quality") == 1 if good is None else good
    toxic = F.col("toxic") == 1 if toxic is None else toxic
    known = (
        labels.where(F.col(label_id).isNotNull()).groupBy(F.bitwise_not(F.col(label_id).cast("long")).alias("other"))
        .agg(F.max(F.coalesce(good, F.lit(False))).alias("good"), F.max(F.coalesce(toxic, F.lit(False))).alias("toxic"))
    )
    joined = flags.join(known, F.bitwise_not("other") == F.col("id"), "left")
    return joined.groupBy(F.col("lang").alias("part"), "mask").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("good", F.lit(False))).alias("good"), F.count_if(F.coalesce("toxic", F.lit(False))).alias("toxic")
    )


def orders() -> list[tuple[int, int, str, int]]:
    """(filter's bit, bits of the filters before it, order, step) for all orders and steps."""
    return [
        (1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in order[:k]), "".join(order), k + 1)
        for order in permutations(FILTERS)
        for k, f in enumerate(order)
    ]


def interactions(flags: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """One row a part, order and step, with what the step keeps, removes and loses, as stated in the module's contract.

    What a step removes depends on its filter and the set of those before it only: masks are counted for these 80 pairs,
    and each pair's row is then repeated for the orders that pass it. A filter's share over all orders follows from the
    masks alone: of the filters that a document fails, each is the first in an equal part of the 120 orders.
    """
    steps: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for bit, before, order, step in orders():
        steps.setdefault((bit, before), []).append((order, step))
    pairs = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(p).alias("before"), F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step")) for o, s in v]).alias("steps")) for (b, p), v in steps.items()])
    n_orders = 1
    for k in range(2, len(FILTERS) + 1):
        n_orders *= k
    bit, before, mask = F.col("pair.bit"), F.col("pair.before"), F.col("mask")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(condition: Column, column: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(F.lit(0)))

    tallied = cells(flags, labels, **names).withColumn("pair", F.explode(pairs)).groupBy("part", "pair").agg(
        total(~earlier & ~fails).alias("kept"),
        total(~earlier & fails).alias("removed"),
        total(earlier & fails).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(~earlier & fails, "good").alias("good_lost"),
        total(~earlier & fails, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * F.expr(f"{n_orders} div bit_count(mask)")).otherwise(F.lit(0))).alias("shapley"),
    )
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return tallied.select("part", F.explode("pair.steps").alias("at"), *counts).select("part", "at.filter_order", "at.step", *counts)
