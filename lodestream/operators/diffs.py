"""Unified diffs: told by the counts that their hunks' headers state, and cut to what changed.

A diff is a row, so one pass over the rows does it: no line is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import small_batches

#: Fixed patterns of a diff's lines.
_RANGE = r"\d+(?:,\d+)?"
_HUNK = re.compile(rf"@@ -{_RANGE} \+{_RANGE} @@|@@@ -{_RANGE} -{_RANGE} \+{_RANGE} @@@|@@@@ -{_RANGE} -{_RANGE} -{_RANGE} \+{_RANGE} @@@@")
_COUNTS = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_FILE = re.compile(r"diff --git a/.+ b/.+$|diff --combined .+$|diff --cc .+$")
_OLD, _NEW = re.compile(r"--- (?:a/.+|/dev/null)$"), re.compile(r"\+\+\+ (?:b/.+|/dev/null)$")
_BINARY = re.compile(r"Binary files .+ differ$")
_MOVED = ("rename ", "similarity ", "copy ", "dissimilarity ")
#: Fixed patterns and weights of what makes a hunk worth keeping.
_PRIORITY = re.compile(r"\b(?:error|exception|fail(?:ed|ure)?|fatal|critical|crash|panic|important|note|todo|fixme|hack|xxx|bug|fix|security|auth|password|secret|token)\b")
BY_CHANGE, BY_CHANGES, BY_WORD, LEAST_WORD, BY_PRIORITY, MOST_SCORE = 0.03, 0.3, 0.2, 2, 0.3, 1.0


def is_diff(text: str) -> bool:
    """Whether a text holds a file with at least one hunk, and every hunk has just the lines that its header counts.

    After `---` and `+++` lines come hunks; in a hunk a blank or space-led line counts for both sides, `-` for the old
    and `+` for the new one, and a note on a missing line end for neither. A hunk that ends early, or is interrupted by
    another line, and a hunk before any file make the whole no diff. Other lines between hunks are let pass.
    """
    old = new = hunks = 0
    files = False
    for line in text.split("\n"):
        if old > 0 or new > 0:
            mark = line[:1]
            old -= mark in ("", " ", "-")
            new -= mark in ("", " ", "+")
            if mark not in ("", " ", "-", "+", "\\") or old < 0 or new < 0:
                return False
        elif line.startswith("--- "):
            files = True
        elif counts := _COUNTS.match(line):
            if not files:
                return False
            old, new = (int(c) if c is not None else 1 for c in counts.groups())
            hunks += 1
    return hunks > 0 and old == new == 0


@dataclass
class Hunk:
    header: str
    lines: list[str] = field(default_factory=list)

    def count(self, mark: str) -> int:
        """Added or removed lines; those that look like a file's name aren't."""
        return sum(x.startswith(mark) and not x.startswith(mark * 3) for x in self.lines)


@dataclass
class File:
    header: str
    old: str = ""
    new: str = ""
    kind: str = ""
    binary: bool = False
    moved: list[str] = field(default_factory=list)
    hunks: list[Hunk] = field(default_factory=list)

    def changes(self) -> int:
        return sum(h.count("+") + h.count("-") for h in self.hunks)


def parsed(lines: list[str]) -> tuple[list[str], list[File]]:
    """(lines before the first file, files with their hunks); combined diffs of several parents included."""
    before: list[str] = []
    files: list[File] = []
    hunk: Hunk | None = None
    for line in lines:
        if _FILE.match(line):
            files.append(File(line))
            hunk = None
            continue
        if not files:
            before.append(line)
            continue
        f = files[-1]
        if line.startswith("new file mode"):
            f.kind = "new"
        elif line.startswith("deleted file mode"):
            f.kind = f.kind or "deleted"
        elif line.startswith(_MOVED):
            f.moved.append(line)
        elif _BINARY.match(line):
            f.binary = True
        if _OLD.match(line):
            f.old = line
        elif _NEW.match(line):
            f.new = line
        elif _HUNK.match(line):
            hunk = Hunk(line)
            f.hunks.append(hunk)
        elif hunk is not None:
            # a line led by three marks that is no file's name is kept, but counts as no change
            hunk.lines.append(line)
    return before, files


def score(hunk: Hunk, words: list[str]) -> float:
    text = "\n".join(hunk.lines).lower()
    own = min(BY_CHANGES, BY_CHANGE * (hunk.count("+") + hunk.count("-")))
    own += BY_WORD * sum(len(w.encode()) > LEAST_WORD and w in text for w in words)
    return min(MOST_SCORE, own + BY_PRIORITY * bool(_PRIORITY.search(text)))


def picked(hunks: list[Hunk], most: int, words: list[str]) -> list[Hunk]:
    """The first and the last hunk and between them those of most score, in the order of their places in the new file."""
    if len(hunks) <= most:
        return hunks
    middle = sorted(hunks[1:-1], key=lambda h: -score(h, words))[: max(0, most - 2)]
    place = lambda h: int(m[1]) if (m := re.search(r"\+(\d+)", h.header)) else 0
    return sorted([hunks[0], *middle, *hunks[-1:]], key=place)


def trimmed(hunk: Hunk, around: int) -> list[str]:
    """Changed lines with `around` lines on either side, and notes on missing line ends."""
    changed = [k for k, x in enumerate(hunk.lines) if x[:1] in ("+", "-")]
    if not changed:
        return hunk.lines[:around]
    near = {j for k in changed for j in range(max(0, k - around), k + around + 1)}
    return [x for k, x in enumerate(hunk.lines) if k in near or x.startswith("\\")]


def shortened(text: str, asked: str = "", around: int = 2, most_hunks: int = 10, most_files: int = 20, least_lines: int = 50, stored_below: float = 0.8) -> tuple:
    """(text, files, additions, deletions, hunks kept, hunks left out, key) of one diff; see `compressed`."""
    lines = text.split("\n")
    before, files = parsed(lines) if len(lines) >= least_lines else ([], [])
    if not files:
        return text, 0, 0, 0, 0, 0, None
    words = asked.lower().split()
    if len(files) > most_files:
        files = sorted(files, key=lambda f: -f.changes())[:most_files]
    out, kept, gone, added, removed = list(before), 0, 0, 0, 0
    for f in files:
        hunks = picked(f.hunks, most_hunks, words)
        kept, gone = kept + len(hunks), gone + len(f.hunks) - len(hunks)
        added, removed = added + sum(h.count("+") for h in f.hunks), removed + sum(h.count("-") for h in f.hunks)
        out += [f.header, *f.moved]
        if f.kind:
            out.append(f"{f.kind} file mode 100644")
        if f.binary:
            out.append("Binary files differ")
            continue
        out += [x for x in (f.old, f.new) if x]
        for h in hunks:
            out += [h.header, *trimmed(h, around)]
    out.append(f"[{len(files)} files changed, +{added} -{removed} lines{f', {gone} hunks omitted' if gone else ''}]")
    body, key = "\n".join(out), None
    n = body.count("\n") + 1
    if n < len(lines) * stored_below:
        key = hashlib.md5(text.encode()).hexdigest()[:24]
        body += f"\n[{len(lines)} lines compressed to {n}. Retrieve full diff: hash={key}]"
    return body, len(files), added, removed, kept, gone, key


def detected(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, diff: whether each text is a unified diff by `is_diff`; null texts aren't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([is_diff(t.as_py() or "") for t in batch.column("text")], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], names=["id", "diff"])

    small_batches(rows.sparkSession)
    slim = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, diff boolean")


def compressed(rows: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """id, text, files, additions, deletions, hunks_kept, hunks_omitted, key: diffs cut to what changed.

    Of files beyond `most_files` those with most changes stay, of a file's hunks the first, the last and those of most
    score, of a hunk the changed lines with two on either side. Renames and notes stay, modes and binary marks are made
    alike. Where the result has under `stored_below` of the lines, a last line has the key under which the whole is to
    be stored. Texts of fewer than `least_lines` lines, and those without a file, come back as they are; null texts
    have no result.
    """
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ["text", "files", "additions", "deletions", "hunks_kept", "hunks_omitted", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shortened(t.as_py(), **options) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], names=["id", *names])

    small_batches(rows.sparkSession)
    slim = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, text string, files long, additions long, deletions long, hunks_kept long, hunks_omitted long, key string")
