"""Kinds of content by patterns over lines. Patterns keep to what all regular-expression engines share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of whole texts.
DIFF = r"(?m)^(diff --git |@@ -[0-9]+(,[0-9]+)? [+][0-9]+(,[0-9]+)? @@)"
HTML = r"^[ \t\n]*<(!doctype html|html|head|body)"
#: Kinds by the share of lines that match, in order of precedence.
LINE_KINDS = {
    "search": (r"^[^ \t\n:]+:[0-9]+:", 0.3),
    "log": (r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2}|\[?(DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\]?[ :])", 0.1),
    "tabular": (r"^[^|\n]*( \| [^|\n]*)+$", 0.5),
    "code": (r"^ *(def |class |import |from [a-z_.]+ import |function |const |let |var |public |private |fn |func |package |#include)", 0.15),
}
#: What changes between otherwise equal texts. Look-arounds and \b are Java's; boundaries are of ASCII words.
VOLATILE = {
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "datetime": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    "date": r"\d{4}-\d{2}-\d{2}(?!\d)",
    "unix_timestamp": r"(?<![0-9])\d{10,13}(?![0-9])",
    "time": r"(?<![0-9])\d{1,2}:\d{2}(?::\d{2})?(?:\s*(?:AM|PM|am|pm))?(?![0-9])",
    "version": r"\bv\d+\.\d+(?:\.\d+)?(?:-[a-zA-Z0-9.]+)?",
    "api_key": r"\b(?:sk|pk|api|key|token|bearer|auth)[-_][a-zA-Z0-9]{16,}",
    "prefixed_id": r"\b[a-z]{2,6}_[a-zA-Z0-9]{8,}",
    "hex_32": r"\b[a-fA-F0-9]{32}\b",
    "hex_40": r"\b[a-fA-F0-9]{40}\b",
    "hex_64": r"\b[a-fA-F0-9]{64}\b",
    "jwt": r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+",
}
STRUCTURE = {"question": r"[?]", "bullet": r"(?m)^ *[-*] ", "numbered": r"(?m)^ *[0-9]+[.)] ", "fence": r"```", "heading": r"(?m)^#{1,6} ", "must": r"(must|should|never|always|only)"}
PATH_KINDS = {
    "lock/generated/vendored": r"/node_modules/|/dist/|[.]min[.]",
    "source code": r"[.](py|js|ts|go|rs|java|c|cpp|rb)($|[?#])",
    "docs/text": r"[.](md|rst|txt|html?)($|[?#])",
    "data/config": r"[.](json|ya?ml|toml|csv|xml)($|[?#])",
}


def first_match(text: Column, patterns: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for kind, p in reversed(list(patterns.items())):
        out = F.when(text.rlike(p), kind).otherwise(out)
    return out


def content_kind(text: Column) -> Column:
    """json, diff, html, search, log, tabular, code or plain: the first that applies."""
    lines = F.split(text, "\n")
    out = F.lit("plain")
    for kind, (p, least) in reversed(list(LINE_KINDS.items())):
        out = F.when(F.size(F.filter(lines, _matches(p))) / F.size(lines) >= least, kind).otherwise(out)
    out = F.when(F.lower(text).rlike(HTML), "html").otherwise(out)
    out = F.when(text.rlike(DIFF), "diff").otherwise(out)
    return F.when(text.rlike(r"^[ \t\n]*[\[{]") & F.try_parse_json(text).isNotNull(), "json").otherwise(out)


def _matches(pattern: str):
    return lambda line: line.rlike(pattern)
