"""Text functions as column expressions. Character classes are explicit, so that every engine reads them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns and word lists that results depend on.
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
TERM = UUID + r"|[0-9]{4,}|[a-z0-9_]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ERROR_WORDS = ("error", "fail", "exception", "traceback", "fatal", "panic", "crash")
IMPORTANCE = {
    "error": ("error", "exception", "fail", "failed", "failure", "fatal", "critical", "crash", "panic", "abort", "timeout", "denied", "rejected"),
    "importance": ("important", "note", "todo", "fixme", "hack", "xxx", "bug", "fix"),
    "warning": ("warn", "warning"),
}
MODEL_FAMILIES = ("opus", "sonnet", "haiku", "fable", "mythos", "gpt", "gemini")


def size_tokens(text: Column, ratio: float = 4.0) -> Column:
    """Token estimate at a fixed number of characters each, rounded to nearest."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / ratio + 0.5).cast("long")


def mixed_tokens(text: Column) -> Column:
    """Token estimate: text, code and JSON at 4, 3.5 and 3.2 characters, address separators and UUIDs extra; at least 1."""
    ratio = F.when(F.ltrim(text).rlike(r"^[\[{]"), 3.2).when(text.rlike(r"(?m)^ *(def|class|import|fn|func|const|let|var|public|private) "), 3.5).otherwise(4.0)
    urls = F.array_join(F.regexp_extract_all(text, F.lit(r"https?://[^ \t\n\x0B\f\r]+"), F.lit(0)), "")
    extra = F.length(urls) - F.length(F.translate(urls, "/?&", "")) + 2 * F.regexp_count(F.lower(text), F.lit(UUID))
    return F.greatest(F.lit(1), F.floor(F.length(text) / ratio).cast("long") + extra)


def input_bucket(tokens: Column) -> Column:
    return F.when(tokens < 2000, "xs").when(tokens < 8000, "s").when(tokens < 32000, "m").when(tokens < 128000, "l").otherwise("xl")


def model_family(model: Column) -> Column:
    out = F.lit("other")
    for name in reversed(MODEL_FAMILIES):
        out = F.when(F.contains(F.lower(model), F.lit(name)), name).otherwise(out)
    return out


def stratum_key(turn: Column, tokens: Column, model: Column, tools: Column) -> Column:
    return F.concat_ws("|", model_family(model), turn, input_bucket(tokens), F.when(tools, "tools").otherwise("plain"))


def arm(key: Column, holdout: float) -> Column:
    """control for a `holdout` share of keys by hash, else treatment."""
    point = F.conv(F.substring(F.sha2(F.concat(F.lit("arm:"), key), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.when(point < holdout, "control").otherwise("treatment")


def content_key(text: Column, digits: int = 24) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def block_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, digits)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), r"[ \t\n\x0B\f\r]+", " ")


def terms(text: Column) -> Column:
    """Search terms: UUIDs, numbers of four and more digits, and runs of a-z, 0-9 and underscore, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def has_error_words(text: Column) -> Column:
    return F.lower(text).rlike("|".join(ERROR_WORDS))


def has_strong_error(text: Column) -> Column:
    """Two different error words at least."""
    hits = F.lit(0)
    for w in ERROR_WORDS:
        hits = hits + F.contains(F.lower(text), F.lit(w)).cast("int")
    return hits >= 2


def importance(line: Column) -> Column:
    """error, importance or warning by the first list with a whole word in the line; null for none."""
    out = F.lit(None).cast("string")
    for kind, listed in reversed(list(IMPORTANCE.items())):
        out = F.when(F.lower(line).rlike(rf"(^|[^a-z0-9_])({'|'.join(listed)})([^a-z0-9_]|$)"), kind).otherwise(out)
    return out


def log_level(line: Column) -> Column:
    found = F.upper(F.regexp_extract(line, r"(?i)(?:^|[^A-Za-z0-9_])(fatal|critical|error|warning|warn|info|debug|trace)(?:[^A-Za-z0-9_]|$)", 1))
    return F.when(found == "CRITICAL", "FATAL").when(found == "WARNING", "WARN").when(found == "", None).otherwise(found)


def hybrid_alpha(query: Column) -> Column:
    """The keyword share of a hybrid score: the more identifiers a query holds, the higher."""
    ids = F.regexp_count(query, F.lit(r"(?:^|[^A-Za-z0-9_])[0-9]{4,}(?:[^A-Za-z0-9_]|$)"))
    a = F.when(F.lower(query).rlike(UUID), 0.85).when(ids >= 2, 0.75).when(ids == 1, 0.65).when(query.rlike(EMAIL), 0.6).otherwise(0.5)
    return F.least(F.greatest(a, F.lit(0.3)), F.lit(0.9))


def volatile_kind(token: Column) -> Column:
    return (
        F.when(F.lower(token).rlike(f"^{UUID}$"), "uuid")
        .when(token.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}"), "iso8601")
        .when(token.rlike(r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$"), "jwt")
        .when(F.lower(token).rlike(r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"), "hex_hash")
    )


def anchors(text: Column) -> Column:
    """Sorted distinct identifiers of a query: UUIDs, long numbers, quoted strings and mail addresses, in lower case."""
    parts = [F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(g)) for p, g in ((UUID, 0), (r"[0-9]{4,}", 0), (r'"([^"]{1,50})"', 1), (EMAIL.replace("A-Za-z", "a-z"), 0))]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def waste(text: Column) -> dict[str, Column]:
    """Characters in markup tags, comments, base64 runs and runs of white space."""
    total = lambda p: F.aggregate(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x)).cast("long")
    return {"tags": total(r"<[A-Za-z/][^<>]*>"), "comments": total(r"<!--[^>]*-->"), "base64": total(r"[A-Za-z0-9+/]{64,}=*"), "spaces": total(r"[ \t\n]{4,}")}


def net_gain(saved: Column, suffix: Column, reads: Column, alive: Column, write: float = 1.25, read: float = 0.1) -> Column:
    """What removing `saved` tokens is worth at the prices of cache writes and reads, less the rewrite of the suffix."""
    reads = F.greatest(F.nanvl(reads, F.lit(0.0)), F.lit(0.0))
    alive = F.least(F.greatest(F.nanvl(alive, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return saved * (write + read * (reads - 1)) - alive * (write - read) * (suffix + saved)


def break_even_reads(saved: Column, suffix: Column, write: float = 1.25, read: float = 0.1) -> Column:
    return (write - read) / read * suffix / saved


def verbosity_level(pressure: Column, turns: Column) -> Column:
    return F.when(turns < 10, 2).when(pressure >= 0.3, 3).when(pressure >= 0.1, 2).otherwise(1)
