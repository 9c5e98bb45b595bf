"""Column expressions over messages, commands, logs and memories."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line marks of build and test tools, in order of precedence.
LOG_MARKS = {
    "pytest": ("=== FAILURES", "=== ERRORS", "=== test session", "=== short test summary", "PASSED [", "FAILED [", "ERROR [", "SKIPPED [", "collected "),
    "npm": ("npm ERR!", "npm WARN", "npm info", "npm http"),
    "cargo": ("Compiling ", "Finished ", "Running ", "warning: ", "error[E"),
    "jest": ("PASS ", "FAIL ", "Test Suites:"),
    "make": ("make[", "make:", "gcc ", "g++ ", "clang "),
}
#: Programs by what they do.
READERS = ("cat", "sed", "head", "tail", "nl", "bat", "more", "read")
SEARCHERS = ("rg", "grep", "ugrep", "ag", "fd", "find")
BUILDERS = ("python", "python3", "pytest", "cargo", "npm", "make", "uv", "ruff")
#: Text that speaks of retrieved passages; CJK characters; names that are no entities; model families.
RAG = r"\[?(source|document|context|passage|chunk)( [0-9]+)?\]?:|retrieved (documents|context)|according to the (document|context)"
CJK = "[぀-ヿ㐀-䶿一-鿿가-힯]"
NO_ENTITIES = ("THE", "AND", "BUT", "FOR", "NOT", "WITH", "FROM")
FAMILIES = ("opus", "sonnet", "haiku", "gpt", "gemini")
RELATIONS = {"uses": "uses", "requires": "requires", "integrates_with": r"integrates\s+with", "depends_on": r"depends\s+on"}


def block_kind(role: Column, text: Column) -> Column:
    return (
        F.when(role == "system", "system").when(role == "tool", "tool_result").when(role == "assistant", "assistant")
        .when(F.lower(text).rlike(RAG), "rag").when(role == "user", "user").otherwise("unknown")
    )


def conversation_key(model: Column, first_text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\x00"), F.substring(first_text, 1, 512)).cast("binary"), 256)


def call_key(name: Column, canonical: Column) -> Column:
    return F.substring(F.md5(F.concat(name, F.lit("\x00"), canonical).cast("binary")), 1, 16)


def log_format(text: Column) -> Column:
    """The format with the most of the first hundred lines, the first of equals; generic without any."""
    head = F.slice(F.split(text, "\n"), 1, 100)
    votes = [F.struct(F.size(F.filter(head, _has(ms))).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, ms) in enumerate(LOG_MARKS.items())]
    best = F.array_max(F.array(*votes))
    return F.when(best["n"] > 0, best["name"]).otherwise("generic")


def _has(marks: Sequence[str]) -> Callable[[Column], Column]:
    return lambda line: reduce(Column.__or__, [F.contains(line, F.lit(m)) for m in marks])


def _simple(command: Column) -> Column:
    """category, path, partial of a command without pipes; category null where its program tells nothing."""
    bare = F.regexp_replace(F.trim(command), r"^((rtk|proxy)\s+)+", "")
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    program = F.element_at(F.split(F.get(words, 0), "/"), -1)
    given = F.transform(F.slice(words, 2, 1000), lambda w: F.regexp_replace(w, "^['\"]|['\"]$", ""))
    is_range = lambda w: w.rlike(r"^\d+([,:-]\d+)?p?$")
    paths = F.filter(given, lambda w: ~w.startswith("-") & w.rlike("/|[.]") & ~is_range(w))
    reads = program.isin(*READERS)
    kind = (
        F.when(F.contains(bare, F.lit("apply_patch")), "edit").when(reads, "read").when(program.isin(*SEARCHERS), "search")
        .when(program == "git", "git").when(program.isin(*BUILDERS), "build/test")
    )
    partial = F.coalesce((kind == "read") & (program.isin("sed", "head", "tail") | F.exists(given, is_range) | F.contains(bare, F.lit("--lines"))), F.lit(False))
    return F.struct(kind.alias("category"), F.when(kind == "read", F.get(paths, 0)).alias("path"), partial.alias("partial"))


def command_class(command: Column) -> Column:
    """What a shell command does: edit, read, search, git, build/test, compound or other, with path and whether in part.

    A chain that doesn't begin with a known program counts as its first read, or as compound.
    """
    whole = _simple(command)
    parts = F.transform(F.split(command, r"&&|\|"), _simple)
    read = F.get(F.filter(parts, lambda p: p["category"] == "read"), 0)
    rest = lambda kind: F.struct(F.lit(kind).alias("category"), F.lit(None).cast("string").alias("path"), F.lit(False).alias("partial"))
    chain = command.rlike(r"&&|\|")
    return F.when(whole["category"].isNotNull(), whole).when(chain & read.isNotNull(), read).when(chain, rest("compound")).otherwise(rest("other"))


def matches_any(name: Column, patterns: Sequence[str]) -> Column:
    """Whether a name is on a list of exact names and globs (* and ?)."""
    out = name.isin(*[p for p in patterns if not set(p) & set("*?")])
    for p in patterns:
        if set(p) & set("*?"):
            out = out | name.like(p.replace("_", "\\_").replace("%", "\\%").replace("*", "%").replace("?", "_"))
    return out


def eval_tokens(text: Column) -> Column:
    """Words in lower case; runs of CJK characters give each pair of neighbours, single ones themselves."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"{CJK}+|[\p{{L}}\p{{N}}_&&[^぀-ヿ㐀-䶿一-鿿가-힯]]+"), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 1)), lambda i: F.substr(w, i, F.lit(2)))
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(CJK), pairs(w)).otherwise(F.array(w))))


def entities(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+[ \t\n]+[A-Z][a-z]+"), F.lit(0))
    camel = F.regexp_extract_all(text, F.lit("[A-Z][a-z]+[A-Z][a-zA-Z]*"), F.lit(0))
    capitals = F.regexp_extract_all(text, F.lit("[A-Z][A-Z_]{2,}"), F.lit(0))
    return F.filter(F.array_distinct(F.concat(runs, camel, capitals)), lambda e: ~e.isin(*NO_ENTITIES) & (F.length(e) < 80))


def _ends(name: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(F.lit(name).alias("relation"), F.regexp_extract(m, r"^\w+", 0).alias("source"), F.regexp_extract(m, r"\w+$", 0).alias("target"))


def relations(text: Column) -> Column:
    """relation, source, target of each verb of RELATIONS between two words."""
    each = []
    for name, verb in RELATIONS.items():
        found = F.regexp_extract_all(text, F.lit(rf"(?i)\w+\s+{verb}\s+\w+"), F.lit(0))
        each.append(F.transform(found, _ends(name)))
    return F.concat(*each)


def memory_block(answer: Column) -> dict[str, Column]:
    """The memories that an answer carries in a <memory> block, as JSON (null without a block), and the answer without it."""
    inside = F.regexp_extract(answer, r"(?s)<memory>\s*(.*?)\s*</memory>", 1)
    return {"memories": F.when(inside != "", F.get_json_object(inside, "$.memories")), "answer": F.trim(F.regexp_replace(answer, r"(?s)<memory>.*?</memory>", ""))}


def keywords(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9_]{3,}"), F.lit(0)))


def relevance(query: Column, sample: Column) -> Column:
    """0 to 1 from a query's keywords and a sample's text: half for the share of words that it has, .2 for each longer one within it."""
    words = keywords(sample)
    shared = F.size(F.array_intersect(query, words)) / F.size(query) * 0.5
    within = F.size(F.filter(query, lambda w: (F.length(w) >= 4) & F.contains(sample, w))) * 0.2
    return F.least(F.lit(1.0), F.when(F.size(words) > 0, shared + within).otherwise(0.0))


def family(model: Column) -> Column:
    out = F.lit("other")
    for name in reversed(FAMILIES):
        out = F.when(F.contains(F.lower(model), F.lit(name)), name).otherwise(out)
    return out


def significant(x: Column, digits: int) -> Column:
    """A number with so many significant digits, as %g writes it; Spark's own formats keep trailing zeros."""

    @F.pandas_udf("string")
    def write(values: pd.Series) -> pd.Series:
        return values.map(f"{{:.{digits}g}}".format, na_action="ignore")

    return write(x)
