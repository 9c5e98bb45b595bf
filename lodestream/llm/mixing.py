"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

* size: the number of runs of characters other than [\x20\x09-\x0D] in the text.
* targets: sources in code-point order, null last, take the weights in turn; they share `share` times all sizes, no
  source above `most` times its own size, the excess shared again by weight until none is above (water filling).
* epochs: within a source documents stand in a pseudo-random order (MD5 of id and seed). A source is read from its
  start as often as its target asks; the document at the target's end counts with the words that are still wanted.
* positions: a source's weight schedule is a piecewise linear function of training time in [0, 1]. Its integral,
  scaled to the target, is the source's cumulative demand; inverting it at the middle of what a document takes in an
  epoch gives the document's training position in that epoch. Documents are range-sorted by position.

Targets are found by windows over one row a source, in one task: that is meant for up to some millions of sources. A
source may hold any share of the rows: running totals come from totals of (source, slot) cells, whose number grows
with the table, so that no task orders a whole source.

Defined results
* null texts have size 0 and take 0; a null source is a source of its own, last in order; null ids sort before others.
* rows that repeat an id are each counted; they stand next to each other in the order, ties by size.
* sources without any words have target 0. An empty table gives an empty result.
* other columns are carried by `mix` and never looked at.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.session import written

#: Rows that a cell holds on average; a window orders one cell at a time.
CELL_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ramp(weights: tuple[float, ...]) -> list[list[tuple[float, float]]]:
    """A schedule for each weight: heavy sources fade out, light ones fade in, each with integral 1."""
    top, low = max(weights), min(weights)
    slopes = [0.0 if top == low else 0.8 * (1 - 2 * (w - low) / (top - low)) for w in weights]
    return [[(0.0, 1 - a), (1.0, 1 + a)] for a in slopes]


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, slot (index of its weight), target from rows (source, size).

    The windows run over one row a source. With sources by the ratio of cap and weight, those before the first that
    stays below its cap are capped, and the others share what is left by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    slot = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("slot") + 1).cast("int"))
    per = per.withColumn("slot", slot).withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.select(
        "*",
        F.row_number().over(by_ratio).alias("k"),
        (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).alias("left"),
        F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)).alias("rest"),
    )
    level = F.col("left") / F.col("rest")
    first_open = F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct("k", level.alias("level")))).over(whole)
    per = per.withColumn("open", first_open)
    target = F.when(F.col("open").isNull() | (F.col("k") < F.col("open.k")), F.col("cap")).otherwise(F.col("open.level") * F.col("weight"))
    return per.select("source", "source_size", "slot", target.alias("target"))


def _inverse(schedule: list[tuple[float, float]], done: Column) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches the share `done` of its whole."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (w0 + w1) / 2 * (t1 - t0)
        pieces.append((t0, t1, w0, w1, total, area))
        total += area
    out = F.lit(schedule[-1][0])
    for t0, t1, w0, w1, before, area in reversed(pieces):
        want = F.greatest(done * total - before, F.lit(0.0))
        bend = (w1 - w0) / (t1 - t0)
        # w0 x + bend x^2 / 2 = want, in the form that is stable for small bends
        x = 2 * want / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * bend * want, F.lit(0.0))))
        out = F.when(done * total <= before + area, F.lit(t0) + F.when(want == 0, 0.0).otherwise(x)).otherwise(out)
    return F.least(out, F.lit(schedule[-1][0]))


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "", schedules: list | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, taken, positions (one for each epoch that takes from the document)."""
    schedules = schedules or ramp(weights)
    key = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(seed)).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("order", key)
    cells, n = 1, docs.count()
    while cells * CELL_ROWS < n:
        cells *= 16
    width = len(f"{cells - 1:x}") if cells > 1 else 0
    rows = rows.withColumn("cell", F.substring("order", 1, width))
    same = ["source", "cell"]
    total = rows.groupBy(*same).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    start = total.select(*same, (F.sum("size").over(W.partitionBy("source").orderBy("cell")) - F.col("size")).alias("cell_start"))
    goal = targets(total.select("source", "size"), weights, share, most)
    cell = start.join(goal, start["source"].eqNullSafe(goal["source"])).select(start["source"].alias("s"), F.col("cell").alias("c"), "cell_start", "source_size", "slot", "target")
    within = W.partitionBy("source", "cell").orderBy("order", F.col("id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(within))
    rows = rows.join(cell, rows["source"].eqNullSafe(cell["s"]) & (rows["cell"] == cell["c"])).withColumn("begin", F.col("cell_start") + F.col("upto") - F.col("size"))
    epochs = F.sequence(F.lit(0), F.ceil(F.lit(float(most))).cast("int"))
    goal_words = F.round("target").cast("long")
    gets = F.transform(epochs, lambda e: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal_words - e * F.col("source_size") - F.col("begin"))))
    rows = rows.withColumn("gets", gets)
    middle = F.transform("gets", lambda g, e: F.struct(g.alias("g"), ((e * F.col("source_size") + F.col("begin") + g / 2) / F.nullif(F.col("target"), F.lit(0.0))).alias("at")))

    def place(x: Column) -> Column:
        out = F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            out = F.when(F.col("slot") == k, _inverse(schedule, x["at"])).otherwise(out)
        return out

    positions = F.transform(F.filter(middle, lambda x: x["g"] > 0), place)
    return rows.select("id", "source", "size", "source_size", "target", F.aggregate("gets", F.lit(0).cast("long"), lambda a, g: a + g).alias("taken"), positions.alias("positions"))


def ordered(planned: DataFrame) -> DataFrame:
    """Rows of `plan` range-sorted by their first position, those that the mix leaves out last, by id."""
    first = planned.withColumn("first_position", F.when(F.size("positions") > 0, F.element_at("positions", 1)))
    keys = [F.col("first_position").asc_nulls_last(), F.col("id").asc_nulls_first()]
    return first.repartitionByRange(*keys).sortWithinPartitions(*keys)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The training order: `docs` with a row for each epoch that takes from it, range-sorted by position.

    A document at a target's end is kept whole. Rows that repeat id, source and size share the plan of one of them.
    """
    chosen = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where(F.col("taken") > 0)
    chosen = chosen.groupBy(F.col("id").alias("__id"), F.col("size").alias("__size"), F.col("source").alias("__source")).agg(F.max("positions").alias("__positions"))
    same = docs[id_col].eqNullSafe(F.col("__id")) & (word_count(docs[text_col]) == F.col("__size")) & docs[source_col].eqNullSafe(F.col("__source"))
    out = docs.join(chosen, same).select(*[docs[c] for c in docs.columns], F.explode("__positions").alias("__position"))
    return out.repartitionByRange("__position").sortWithinPartitions("__position").drop("__position")


def positions(mixed: DataFrame) -> DataFrame:
    """A table that `mix` was written to, with each row's `position` in the training order, from 0.

    The order is that of the numbers in the files' names, then of the names, and of the rows in each. The window runs
    over one row a file. Where rows
    don't come from files, the order is that of the DataFrame's own partitions.
    """
    try:
        rows = mixed.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        rows = mixed.withColumn("__id", F.monotonically_increasing_id())
        rows = rows.withColumn("__file", F.lpad(F.shiftright("__id", 33).cast("string"), 12, "0")).withColumn("__row", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")
    files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    # by the numbers of task and file, which outgrow the width that they are padded to
    number = lambda pattern: F.coalesce(F.expr("try_cast(regexp_extract(__file, '" + pattern + "', 1) AS long)"), F.lit(-1))
    in_order = W.orderBy(number("^part-([0-9]+)"), number("-c([0-9]+)[.]"), "__file")
    starts = files.select(F.upper("__file").alias("__key"), (F.sum("__n").over(in_order) - F.col("__n")).alias("__start"))
    starts = written(starts, "file-starts")  # of known size, so that the planner can tell whether to broadcast it
    return rows.join(starts, F.upper("__file") == F.col("__key")).withColumn("position", F.col("__start") + F.col("__row")).drop("__file", "__row", "__key", "__start")
