"""Stack traces in ordered lines: a finite-state machine over lines, run in parallel as a prefix of its state maps.

A line opens a trace, carries one on or ends it, by rules of five makes; a trace has TRACE_LINES lines at most. What a
line does depends on the state before it: none, or a make with the number of lines so far. Lines are cut into chunks;
each chunk's lines are folded into one map from the state before to the state after, the maps of a log's chunks are
applied in order (a row of 101 bytes a chunk), and then each chunk's lines are labelled from the state it starts in.
So a log of any length is spread over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Makes of traces, in the order in which their openers are tried, and the most lines of a trace.
MAKES, TRACE_LINES = ("python", "js", "java", "rust", "go"), 20
#: Lines in a chunk.
CHUNK = 4096

#: Fixed patterns of lines that open a trace of each make, after leading white space.
_OPENERS = tuple(map(re.compile, (
    r'Traceback \(most recent call last\)|File ".*", line .*[0-9]$', r"at (?=.*\()(?=.*\)).*:[0-9]+:[0-9]", r"at [A-Za-z0-9._$]+\(", r"--> .*:[0-9]+:[0-9]", r"[0-9]+: *0x[0-9a-fA-F]",
)))
_CARRIES_ON = ("Traceback", "File ", "During handling", "The above exception")


def symbol(line: str) -> int:
    """What a line can do: the make that it opens (0 for none) times 16, plus a bit for each kind of trace that it ends."""
    bare = line.lstrip()
    opens = next((k for k, opener in enumerate(_OPENERS, 1) if opener.match(bare)), 0) if bare[:1] in ("T", "F", "a", "-") or bare[:1].isdigit() else 0
    if not line:
        return opens << 4
    python = not (line[0] in " \t" or bare.startswith(_CARRIES_ON) or bare[:1].isupper())
    other = (not bare.startswith("at "), not bare.startswith("--> "), not ("0" <= bare[:1] <= "9"))
    return opens << 4 | python | other[0] << 1 | other[1] << 2 | other[2] << 3


def step(state: int, sym: int) -> int:
    """The state after a line; 0 is none, others count make and lines."""
    opens = sym >> 4
    if state:
        make, lines = divmod(state - 1, TRACE_LINES)
        ends = sym >> (0 if make == 0 else make - 1 if make > 1 else 1) & 1
        if lines + 1 < TRACE_LINES and not ends:
            return state + 1
    return (opens - 1) * TRACE_LINES + 1 if opens else 0


def _maps() -> np.ndarray:
    """The state after, for each symbol and state before."""
    states = len(MAKES) * TRACE_LINES + 1
    return np.array([[step(s, sym) for s in range(states)] for sym in range((len(MAKES) + 1) * 16)], np.uint8)


def labelled(symbols: list[int], state: int = 0) -> list[int]:
    """The state after each line; a line is within a trace where it isn't 0."""
    out = []
    for sym in symbols:
        state = step(state, sym)
        out.append(state)
    return out


def trace_lines(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """id, at, trace (the make, or null outside of traces), nth (of the trace's lines, from 1) of lines (id, at, line).

    at counts each id's lines from 0 without gaps; null lines are empty.
    """
    kind = lines.schema["id"].dataType.simpleString()
    keyed = lines.select("id", "at", F.coalesce("line", F.lit("")).alias("line"), F.expr(f"at div {chunk}").alias("chunk"))
    last = keyed.groupBy("id").agg(F.max("chunk").alias("last")).where("last > 0")
    early = keyed.join(last, "id").where("chunk < last")
    maps = _maps()

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy())
        texts = table.column("line").to_pylist()
        state = np.arange(maps.shape[1], dtype=np.uint8)
        for k in order.tolist():
            state = maps[symbol(texts[k])][state]
        return pa.table({"id": table.column("id").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "map": pa.array([state.tobytes()], pa.binary())})

    folded = early.groupBy("id", "chunk").applyInArrow(fold, f"id {kind}, chunk long, map binary")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, 0
        for batch in batches:
            states = []
            for of, nth, table in zip(*(batch.column(c).to_pylist() for c in ("id", "chunk", "map"))):
                state = table[state if nth and of == now else 0]
                now = of
                states.append(state)
            after = pa.array([c + 1 for c in batch.column("chunk").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), after, pa.array(states, pa.int32())], names=["id", "chunk", "state"])

    begins = folded.repartition("id").sortWithinPartitions("id", "chunk").mapInArrow(apply, f"id {kind}, chunk long, state int")

    def label(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy())
        texts = table.column("line").to_pylist()
        states = labelled([symbol(texts[k]) for k in order.tolist()], table.column("state")[0].as_py() or 0)
        found = [divmod(s - 1, TRACE_LINES) if s else None for s in states]
        table = table.take(pa.array(order))
        made = pa.array([MAKES[f[0]] if f else None for f in found], pa.string())
        return pa.table({"id": table.column("id"), "at": table.column("at"), "trace": made, "nth": pa.array([f[1] + 1 if f else None for f in found], pa.int32())})

    met = keyed.join(begins, ["id", "chunk"], "left")
    return met.groupBy("id", "chunk").applyInArrow(label, f"id {kind}, at {lines.schema['at'].dataType.simpleString()}, trace string, nth int")
