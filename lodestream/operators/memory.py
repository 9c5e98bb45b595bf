"""Memory tables: scoped filters, promotion, budgets, sync and reads that later reads or edits replace."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Scopes from the widest, and columns that results may be ordered by.
SCOPES = ("user_id", "session_id", "agent_id", "turn_id")
ORDERS = ("created_at", "importance", "access_count", "last_accessed", "valid_from")


def where(rows: DataFrame, scope: dict | None = None, created: tuple | None = None, valid_at=None, superseded: bool = False, importance: tuple | None = None, entities: list | None = None, metadata: dict | None = None) -> DataFrame:
    """Rows that pass all conditions given. Metadata keys that aren't plain names are skipped."""
    keep: Column = F.lit(True)
    for name, value in (scope or {}).items():
        keep &= F.col(name) == value
    if created:
        keep &= F.col("created_at").between(*[F.lit(x) for x in created])
    if valid_at is not None:
        keep &= (F.col("valid_from") <= F.lit(valid_at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.lit(valid_at)))
    if not superseded:
        keep &= F.col("superseded_by").isNull()
    if importance:
        keep &= F.col("importance").between(*importance)
    if entities:
        keep &= F.arrays_overlap("entity_refs", F.array(*map(F.lit, entities)))
    for name, value in (metadata or {}).items():
        if name.replace("_", "").isalnum() and name.isascii():
            keep &= F.get_json_object("metadata", f"$.{name}") == F.lit(value if isinstance(value, str) else json.dumps(value))
    return rows.where(keep)


def page(rows: DataFrame, order: str = "created_at", limit: int = 100, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.desc(order if order in ORDERS else "created_at"), "id").offset(offset).limit(limit)


def scope_of(session: Column, agent: Column, turn: Column) -> Column:
    return F.when(turn.isNotNull(), "turn").when(agent.isNotNull(), "agent").when(session.isNotNull(), "session").otherwise("user")


def bubbled(rows: DataFrame, least: float) -> DataFrame:
    """rows and, of those below user scope with enough importance, a copy at user scope that names its origin."""
    narrow = F.coalesce(*[F.col(c).cast("string") for c in SCOPES[1:]]).isNotNull()
    up = rows.where(narrow & (F.col("importance") >= least)).withColumns({"promoted_from": F.col("id"), "id": F.concat(F.col("id"), F.lit(":user")), **{c: F.lit(None).cast(rows.schema[c].dataType) for c in SCOPES[1:]}})
    return rows.withColumn("promoted_from", F.lit(None).cast(rows.schema["id"].dataType)).unionByName(up)


def missing(rows: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """Rows whose content the other side lacks, by hash: for import and, with sides swapped, export."""
    key = lambda df: df.withColumn("__h", F.sha2(F.col(text).cast("binary"), 256))
    return key(rows).join(key(known).select("__h").distinct(), "__h", "left_anti").drop("__h")


def within_budget(rows: DataFrame, group: str, text: str, score: str, budget: int, overhead: int = 10) -> DataFrame:
    """Greedy fit by score: an entry that doesn't fit is skipped and smaller ones may follow.

    Order-dependent, so that each group is folded in one task; rows carry ids and sizes only, and join their texts back.
    """
    slim = rows.select(group, "id", F.col(score).alias("score"), (F.floor(F.length(text) / 4 + 0.5) + overhead).cast("long").alias("cost"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        for r in pdf.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            if r.cost <= left:
                left -= r.cost
                keep.append(r.id)
        return pdf[pdf["id"].isin(keep)][[group, "id", "cost"]]

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.groupBy(group).applyInPandas(fit, f"{group} {kinds[group]}, id {kinds['id']}, cost long")


def read_states(ops: DataFrame, session: str, path: str, order: str, default_limit: int = 2000) -> DataFrame:
    """Reads with state: stale if a later edit of the file follows, superseded if a later read covers theirs, else fresh.

    ops has kind (read or edit), offset and limit; a read without limit from the start covers everything.

    Whether a later read covers an earlier one is settled at one level of a binary tree over a file's reads in order: the
    one whose halves part the two. At each level reads are swept by where they begin, with the running maximum of the
    ends of the later half; so n reads take n log n rows, and none holds a list of others.
    """
    begin = F.coalesce("offset", F.lit(0)).cast("long")
    whole = (begin == 0) & F.col("limit").isNull()
    end = F.when(whole, F.lit(2**62)).otherwise(begin + F.coalesce("limit", F.lit(default_limit)))
    reads = ops.where(F.col("kind") == "read").withColumns({"__b": begin, "__e": end})
    edits = ops.where(F.col("kind") == "edit").groupBy(F.col(session).alias("__s"), F.col(path).alias("__p")).agg(F.max(order).alias("__edited"))
    group = W.partitionBy("__s", "__p")
    spans = reads.select(F.col(session).alias("__s"), F.col(path).alias("__p"), F.col(order).alias("__o"), "__b", "__e").distinct()
    spans = spans.withColumn("__at", (F.dense_rank().over(group.orderBy("__o")) - 1).cast("long"))
    last = spans.groupBy("__s", "__p").agg(F.max("__at").alias("__last")).select(F.col("__s").alias("__s2"), F.col("__p").alias("__p2"), "__last")
    placed = spans.join(last, F.col("__s").eqNullSafe(F.col("__s2")) & F.col("__p").eqNullSafe(F.col("__p2")))
    level = F.explode(F.sequence(F.lit(0), F.length(F.bin("__last")) - 1)).alias("__level")
    placed = placed.where("__last > 0").select("__s", "__p", "__o", "__b", "__e", "__at", level)
    later = F.expr("shiftright(__at, __level) & 1") == 1
    block = F.expr("shiftright(__at, __level + 1)")
    # of reads that begin alike the longer comes first, of equal ones the later
    sweep = W.partitionBy("__s", "__p", "__level", "__block").orderBy("__b", F.desc("__e"), F.desc("__later")).rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = placed.withColumns({"__block": block, "__later": later}).withColumn("__reach", F.max(F.when(F.col("__later"), F.col("__e"))).over(sweep))
    covered = swept.where(~F.col("__later") & (F.col("__reach") >= F.col("__e"))).select("__s", "__p", "__o", "__b", "__e").distinct()
    covered = covered.toDF("__cs", "__cp", "__co", "__cb", "__ce").withColumn("__covered", F.lit(True))
    same = lambda *pairs: reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in pairs))
    out = reads.join(edits, same((session, "__s"), (path, "__p")), "left")
    out = out.join(covered, same((session, "__cs"), (path, "__cp"), (order, "__co"), ("__b", "__cb"), ("__e", "__ce")), "left")
    state = F.when(F.col("__edited") > F.col(order), "stale").when(F.col("__covered"), "superseded").otherwise("fresh")
    return out.select(*ops.columns, state.alias("state"))


def tool_units(calls: DataFrame, results: DataFrame, conversation: str) -> DataFrame:
    """conversation, at, answers: each call message with the sorted places of its results; a call's last result counts."""
    last = results.groupBy(conversation, "call_id").agg(F.max("at").alias("answer"))
    return calls.join(last, [conversation, "call_id"]).groupBy(conversation, "at").agg(F.sort_array(F.collect_set("answer")).alias("answers"))


def recoveries(calls: DataFrame, session: str, order: str, back: int = 5) -> DataFrame:
    """Successful calls with the latest failed call of the same tool among the `back` before, and their edit distance."""
    before = W.partitionBy(session).orderBy(order).rowsBetween(-back, -1)
    failed = F.filter(F.collect_list(F.struct(order, "tool", "input", "is_error")).over(before), lambda c: c["is_error"])
    same = F.filter("__failed", lambda c: c["tool"] == F.col("tool"))
    out = calls.withColumn("__failed", failed).where(~F.col("is_error")).withColumn("__last", F.try_element_at(same, F.lit(-1)))
    out = out.where(F.col("__last").isNotNull()).withColumn("failed_input", F.col("__last.input")).withColumn("distance", F.levenshtein("input", "failed_input"))
    return out.drop("__failed", "__last")


def by_batches(rows: DataFrame, f, schema: str) -> DataFrame:
    """rows through a function from pandas frames to pandas frames, batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield f(frame)

    return rows.mapInPandas(run, schema)
