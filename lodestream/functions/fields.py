"""Renderings of records and rules over the cells and lines of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions import detect

#: Patterns and lists that results depend on.
IMAGE_DATA = r"data:image/[a-z+.-]+;base64,[A-Za-z0-9+/]+=*"
KNOWN_TAGS = (
    "a abbr address article aside audio b blockquote body br button canvas caption code col colgroup dd div dl dt em fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label legend li link main meta nav noscript object ol option p picture pre q s script section "
    "select small source span strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr u ul var video"
).split()
MIXED = {"fence": r"```", "json": r"(?m)^[ \t]*[\[{]", "search": r"(?m)^[^ \t\n:]+:[0-9]+:"}
SENTENCE = r"[.!?]+[ \t\n]+[A-Z]"
SEGMENT_END = r"\n|[.!?]+[ \t]+"
SALIENT = r"[0-9]|(^|[^A-Za-z])[A-Z]{2,}($|[^A-Za-z])|[A-Za-z_][.][A-Za-z_]+[.][A-Za-z_]"
LANGUAGE_VOTES = {
    "python": r"(?m)^ *(def [a-z_]|class [A-Z]|import [a-z]|from [a-z.]+ import|elif |if __name__)",
    "javascript": r"(?m)(^ *(const|let|var|function) |=> [{(]|console[.]log|require[(])",
    "java": r"(?m)^ *(public|private|protected) (static |final )*[A-Za-z<>]+ ",
    "go": r"(?m)^(package |func |type [A-Z][A-Za-z]* (struct|interface))",
    "rust": r"(?m)^ *(pub )?(fn |impl |mod |use [a-z_]+::|struct )",
    "c": r"(?m)^(#include|#define|(static )?(int|void|char) [a-z_*]+[(])",
}
ERROR_CLASSES = {
    "file_not_found": r"no such file|file not found|enoent",
    "permission": r"permission denied|access denied|forbidden|eacces",
    "timeout": r"timed out|timeout|deadline exceeded",
    "network": r"connection (refused|reset)|unreachable|dns",
    "syntax": r"syntax ?error|unexpected token|parse error",
    "missing_command": r"command not found|not recognized as",
    "other": r"error|fail|exception",
}
RETRIEVED = r"\[?(source|document|context|passage|chunk)( [0-9]+)?\]?:|retrieved (documents|context)|according to the (document|context)"
TASKS = {
    "code": r"(^|[^a-z])(code|function|class|debug|compile)($|[^a-z])",
    "summary": r"summar|tl;dr|shorten",
    "translation": r"translat",
    "question": r"[?]",
}


def quoted(cell: Column) -> Column:
    """A CSV cell: quoted only where it holds a comma, a quote or a line break; null is the empty cell."""
    body = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.isNull(), "").when(cell.rlike(r'[,"\n\r]'), body).otherwise(cell)


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *[quoted(c) for c in cells])


def key_value_lines(cells: dict[str, Column]) -> Column:
    """A line for each cell that is there; missing ones leave none."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), c.cast("string")) for name, c in cells.items()])


def cell_class(cell: Column, long_bytes: int = 256) -> Column:
    """null, json, base64, html, long or scalar: the first that applies."""
    return (
        F.when(cell.isNull(), "null")
        .when(cell.rlike(r"^[ \t\n]*[\[{]") & F.try_parse_json(cell).isNotNull(), "json")
        .when((F.length(cell) >= 64) & cell.rlike("^[A-Za-z0-9+/]+=*$"), "base64")
        .when(F.lower(cell).rlike(detect.HTML), "html")
        .when(F.octet_length(cell) > long_bytes, "long")
        .otherwise("scalar")
    )


def without_images(text: Column) -> Column:
    return F.regexp_replace(text, IMAGE_DATA, "[image]")


def content_parts(text: Column) -> Column:
    """How many kinds of content a text mixes: fences, JSON blocks, search hits, more than five sentences."""
    kinds = [text.rlike(p).cast("int") for p in MIXED.values()] + [(F.regexp_count(text, F.lit(SENTENCE)) > 5).cast("int")]
    return sum(kinds[1:], kinds[0])


def runs(values: Column) -> Column:
    """Runs of equal neighbours in an array of strings without nulls: array of (begins, ends, value), ends exclusive.

    Neighbours meet by zipping the array with itself one place on, so that the work is linear in its length. Each array
    is bound by a lambda, so that it is computed once. A null array has no runs.
    """

    def starts(v: Column) -> Column:
        pairs = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), v).alias("before"), v.alias("now"))
        marked = F.transform(pairs, lambda p, i: F.struct(i.alias("at"), p["before"].alias("before"), p["now"].alias("now")))
        begun = F.filter(marked, lambda p: p["now"].isNotNull() & (p["before"].isNull() | (p["before"] != p["now"])))
        return F.struct(begun.alias("begun"), F.size(v).alias("n"))

    def spans(r: Column) -> Column:
        ends = F.concat(F.transform(F.slice(r["begun"], 2, F.size(r["begun"])), lambda p: p["at"]), F.array(r["n"]))
        zipped = F.slice(F.arrays_zip(r["begun"].alias("s"), ends.alias("e")), 1, F.size(r["begun"]))
        return F.transform(zipped, lambda z: F.struct(z["s"]["at"].alias("begins"), z["e"].alias("ends"), z["s"]["now"].alias("value")))

    whole = F.coalesce(values, F.array().cast("array<string>"))
    return F.transform(F.transform(F.array(whole), starts), spans)[0]


def line_kinds(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda line: detect.first_match(line, {k: p for k, (p, _) in detect.LINE_KINDS.items()}, "plain"))


def template(line: Column) -> Column:
    return F.regexp_replace(line, "[0-9]+", "#")


def segments(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SEGMENT_END), lambda s: F.trim(s)), lambda s: s != "")


def code_language(text: Column, least: int = 3) -> Column:
    """The language with the most votes, at least `least`, the first listed of equals; else null."""
    votes = {k: F.regexp_count(text, F.lit(p)) for k, p in LANGUAGE_VOTES.items()}
    most = F.greatest(*votes.values())
    out = F.lit(None).cast("string")
    for kind, n in reversed(list(votes.items())):
        out = F.when(n == most, kind).otherwise(out)
    return F.when(most >= least, out)


def log_bloat(text: Column, importance, least_lines: int = 50) -> Column:
    """Half the share of repeated lines, half that of unimportant ones; 0 for short texts."""
    lines = F.split(text, "\n")
    repeated = 1 - F.size(F.array_distinct(lines)) / F.size(lines)
    low = F.size(F.filter(lines, lambda x: importance(x).isNull())) / F.size(lines)
    return F.when(F.size(lines) < least_lines, 0.0).otherwise(0.5 * repeated + 0.5 * low)


def search_bloat(text: Column, least: int = 10) -> Column:
    """How many hits a file has beyond the first, in tens, at most 1; 0 below `least` hits."""
    files = F.regexp_extract_all(text, F.lit(r"(?m)^([^ \t\n:]+):[0-9]+:"), F.lit(1))
    each = (F.size(files) / F.greatest(F.lit(1), F.size(F.array_distinct(files))) - 1) / 10
    return F.when(F.size(files) < least, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), each)))


def json_bloat(text: Column) -> Column:
    return F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"[}][ \t\n]*,")) / 49)


def opaque_words(text: Column, least: float = 0.7) -> Column:
    """Words of eight and more ASCII letters and digits, both among them, whose characters' entropy is high for their length."""
    found = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]{8,}"), F.lit(0)), lambda w: w.rlike("[A-Za-z]") & w.rlike("[0-9]"))

    def entropy(w: Column) -> Column:
        share = lambda c: (F.length(w) - F.length(F.replace(w, c, F.lit("")))) / F.length(w)
        return F.aggregate(F.array_distinct(F.split(w, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c)))) / F.log2(F.length(w))

    return F.filter(found, lambda w: F.round(entropy(w), 6) >= least)


def diff_noise(hunk: Column, path: Column) -> Column:
    """lockfile, whitespace or null: hunks that say nothing to a reader. A hunk without changes is white space only."""
    lines = F.split(hunk, "\n")
    body = lambda sign: F.regexp_replace(F.array_join(F.transform(F.filter(lines, lambda x: x.startswith(sign)), lambda x: F.substring(x, 2, 1 << 30)), ""), r"[ \t\r]+", "")
    locked = path.rlike(r"(^|/)([a-z-]+[.]lock|package-lock[.]json|pnpm-lock[.]yaml|go[.]sum)$")
    return F.when(locked, "lockfile").when(body("+") == body("-"), "whitespace")
