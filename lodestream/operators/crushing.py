"""One JSON document crushed within its row: the rule of `trees`, for documents that a task can hold with all their items."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np

from lodestream.operators import adaptive
from lodestream.operators.tables import Number, as_spark, dump, load, marker, opaque_kind, table_of

#: Deepest level that is opened, fewest items of an array and keys of an object that are looked at, most
#: items that stay of an array by its k, and the least share of bytes that a table must save.
DEEPEST, LEAST_ITEMS, MOST_ITEMS, LEAST_SAVED = 50, 5, 15, 0.15
#: Fewest tokens of an object that loses keys, and the most tokens of a key that always stays.
OBJECT_TOKENS, SMALL_TOKENS = 200, 12
#: Words that mark an item as one that tells of an error.
ERROR_KEYWORDS = ("error", "exception", "failed", "failure", "critical", "fatal", "crash", "panic", "abort", "timeout", "denied", "rejected")
#: Arrays of one of these types are cut as a whole, by the type of their items.
CUT = {"dict": "dicts", "str": "strings", "number": "numbers"}

_KINDS = {dict: "dict", Number: "number", str: "str", bool: "bool", list: "list"}
#: What Java's \s is.
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def item_kind(value: object) -> str:
    """dict, str, number, bool, list or none, of what `load` gives."""
    return _KINDS.get(type(value), "none")


def array_kind(items: list) -> str:
    """The type of a whole array: dicts, strings, numbers, bools, nested, mixed or empty."""
    kinds = {item_kind(x) for x in items}
    if not kinds:
        return "empty"
    if len(kinds) > 1 or kinds == {"none"}:
        return "mixed"
    return {**CUT, "bool": "bools", "list": "nested"}[kinds.pop()]


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def _errors(texts: list[str]) -> list[bool]:
    low = "\n".join(texts).lower()
    some = [k for k in ERROR_KEYWORDS if k in low]
    return [any([k in text.lower() for k in some]) for text in texts] if some else [False] * len(texts)


def _spread(xs: list[float]) -> tuple[float, float | None]:
    """Mean and sample deviation as Spark sums them; None for one value."""
    total = mean = squares = 0.0
    for n, x in enumerate(xs, 1):
        total += x
        delta = x - mean
        mean += delta / n
        squares += delta * (delta - delta / n)
    return total / len(xs), math.sqrt(squares / (len(xs) - 1)) if len(xs) > 1 else None


def _away(xs: list[float], sigmas: float = 2.0) -> tuple[list[bool], float | None]:
    mean, deviation = _spread(xs)
    if not deviation or not deviation > 0:
        return [False] * len(xs), deviation
    return [abs(x - mean) > sigmas * deviation for x in xs], deviation


def _turns(xs: list[float], deviation: float | None, window: int = 5, sigmas: float = 2.0) -> list[bool]:
    out = [False] * len(xs)
    if len(xs) > 2 * window and deviation and deviation > 0:
        for p in range(window, len(xs) - window):
            before = after = 0.0
            for j in range(window):
                before += xs[p - window + j]
                after += xs[p + j]
            out[p] = abs(after / window - before / window) > sigmas * deviation
    return out


def _clusters(lowered: list[str]) -> int:
    """How many first representatives the hashes of an array have."""
    hashes = np.array(list(dict.fromkeys(adaptive.hashes_of(lowered, adaptive._GRAMS).tolist())), np.uint64)
    if len(hashes) <= adaptive.FEW and np.count_nonzero(np.bitwise_count(hashes[:, None] ^ hashes) <= adaptive.ALIKE) == len(hashes):
        return len(hashes)
    left, n = hashes, 0
    while len(left):  # the first one left stands for itself and takes what is close to it
        left, n = left[np.bitwise_count(left ^ left[0]) > adaptive.ALIKE], n + 1
    return n


def _knee(lowered: list[str]) -> int | None:
    """Items up to where the curve of distinct word pairs lies highest above its chord, as in `adaptive.bend`."""
    seen: set[str] = set()
    curve = []
    for text in lowered:
        words = [w for w in _SPACE.split(text) if w]
        if len(words) < 2:
            seen.add((words[0] if words else "") + " ")
        else:
            seen.update(f"{a} {b}" for a, b in zip(words, words[1:]))
        curve.append(len(seen))
    low, high = curve[0], curve[-1]
    if high == low:
        return 1
    gains = (np.array(curve) - low) / (high - low) - np.arange(len(curve)) / (len(curve) - 1)
    best = int(np.argmax(gains))
    return best + 1 if gains[best] >= adaptive.LEAST_GAIN else None


def _deflated(items: list[str], k: int) -> tuple[int, float, float]:
    """Bytes of the items joined by line ends, their deflated share and that of the first k, as in `adaptive.deflated_ratios`."""
    packer, size, packed, part = zlib.compressobj(1), 0, 0, 1.0
    for pos, item in enumerate(items):
        raw = ("\n" if pos else "").encode() + item.encode()
        size += len(raw)
        packed += len(packer.compress(raw))
        if pos == k - 1 and size:
            part = (packed + len(packer.copy().flush())) / size
    return size, (packed + len(packer.flush())) / size if size else 1.0, part


def optimal_k(items: list[str], bias: float = 1.0, min_k: int = 3, cap: int = MOST_ITEMS) -> int:
    """How many items an array should keep, as in `adaptive.optimal_k`."""
    n = len(items)
    if n <= adaptive.WHOLE:
        return n
    lowered = [x.lower() for x in items]
    kinds = _clusters(lowered)
    if kinds <= 3:
        return min(max(min_k, kinds), cap)
    knee = _knee(lowered)
    floor = max(min_k, math.floor(n * (adaptive.BASE_SHARE + (1 - adaptive.BASE_SHARE) * (kinds / n))))
    chosen = floor if knee is None else max(knee, floor) if kinds / n > adaptive.DIVERSE else knee
    k = min(max(min_k, math.floor(chosen * float(bias))), cap)
    if k < n and k < cap:
        size, whole, first = _deflated(items, k)
        if size >= adaptive.LEAST_BYTES and abs(whole - first) > adaptive.RATIO_GAP:
            k = max(min_k, min(math.floor(k * adaptive.GROWTH), cap))
    return k


def sampled(items: list[str], must: list[bool], extra: list[int], k: int, distinct: bool = True) -> list[str]:
    """whole, marked, edge, stride or dropped for each item, as in `adaptive.sampled`."""
    n = len(items)
    if n <= adaptive.WHOLE:
        return ["whole"] * n
    first = min(max(1, round(k * 0.3)), k)
    last = min(max(1, round(k * 0.15)), k - first)
    why = ["marked" if must[p] else "edge" if p < first or p >= n - last else "dropped" for p in range(n)]
    kept = n - why.count("dropped")
    room, places = max(k - kept, 0), k + sum(extra) - kept
    if room > 0:
        seen = {items[p] for p in range(n) if why[p] != "dropped"} if distinct else set()
        for p in range(0, n, max(1, (n - 1) // (room + 1))):
            if places <= 0:
                break
            if why[p] == "dropped" and items[p] not in seen:
                why[p] = "stride"
                places -= 1
                if distinct:
                    seen.add(items[p])
    return why


def _odd(items: list[dict], texts: list[str]) -> list[bool]:
    """Objects that tell of an error, have a number far from its field's mean, or a field that few of them have."""
    out = _errors(texts)
    places: dict[str, list[int]] = {}
    for p, x in enumerate(items):
        for field in x:
            places.setdefault(field, []).append(p)
    for field, at in places.items():
        numbers = [p for p in at if isinstance(items[p][field], Number)]
        far, _ = _away([float(items[p][field]) for p in numbers]) if numbers else ([], None)
        for p in [p for p, odd in zip(numbers, far) if odd] + (at if len(at) < 0.2 * len(items) else []):
            out[p] = True
    return out


class Crusher:
    """Crushes one document after another; what it cuts off is in `cut`, as (hash, content)."""

    def __init__(self, bias: float = 1.0, lossless: bool = True):
        self.bias, self.lossless = bias, lossless
        self.cut: list[tuple[str, str]] = []

    def document(self, text: str) -> tuple[str, bool]:
        """(crushed, changed); a text that is no JSON comes back as it is."""
        self.cut = []
        value = load(text)
        if value is None and text.strip() != "null":
            return text, False
        return self._node(value, 0)

    def _node(self, value: object, depth: int) -> tuple[str, bool]:
        if depth >= DEEPEST:
            return dump(value), False
        if isinstance(value, dict):
            return self._object(value, depth)
        if isinstance(value, list):
            kind = array_kind(value)
            if len(value) >= LEAST_ITEMS and kind in (*CUT.values(), "mixed"):
                return self._array(value, kind)
            parts = [self._node(x, depth + 1) for x in value]
            return "[" + ",".join([t for t, _ in parts]) + "]", any(c for _, c in parts)
        if isinstance(value, str) and not isinstance(value, Number):
            inner = load(value, containers_only=True)
            if inner is not None:
                text, changed = self._node(inner, depth + 1)
                return (dump(value) if not changed else text if text.startswith('"') else as_spark(text)), changed
            if opaque_kind(value) is not None:
                self.cut.append((_hash(value), as_spark(value)))
                return dump(marker(value)), True
        return dump(value), False

    def _object(self, value: dict, depth: int) -> tuple[str, bool]:
        names = list(value)
        parts = [self._node(value[name], depth + 1) for name in names]
        texts, changed = [t for t, _ in parts], any(c for _, c in parts)
        stays = [True] * len(names)
        if len(names) > adaptive.WHOLE:
            tokens = [len(t.encode()) // 4 + len(name.encode()) // 4 + 2 for name, t in zip(names, texts)]
            if sum(tokens) >= OBJECT_TOKENS:
                k = optimal_k([f"{name}: {t}" for name, t in zip(names, texts)])
                if k < len(names):
                    error = _errors(texts)
                    must = [e or n <= SMALL_TOKENS for e, n in zip(error, tokens)]
                    stays = [w != "dropped" for w in sampled(names, must, list(map(int, error)), k, False)]
        inner = ",".join([f"{as_spark(name)}:{t}" for name, t, stay in zip(names, texts, stays) if stay])
        return "{" + inner + "}", changed or not all(stays)

    def _array(self, items: list, kind: str) -> tuple[str, bool]:
        texts = [dump(x) for x in items]
        if kind != "mixed":
            csv, kept = self._group(items, texts, kind[:-1], False)
            if csv is not None:
                return as_spark(csv), True
        else:
            kept = [True] * len(items)
            groups: dict[str, list[int]] = {}
            for p, x in enumerate(items):
                groups.setdefault(item_kind(x), []).append(p)
            for own, at in groups.items() if len(items) > adaptive.WHOLE else ():
                if own in CUT and len(at) >= LEAST_ITEMS:
                    _, stay = self._group([items[p] for p in at], [texts[p] for p in at], {"str": "string"}.get(own, own), True)
                    for p, s in zip(at, stay):
                        kept[p] = s
        gone = len(kept) - sum(kept)
        note = ""
        if kind == "dicts" and gone:
            content = "[" + ",".join(texts) + "]"
            self.cut.append((_hash(content), content))
            note = f',{{"_ccr_dropped":"<<ccr:{self.cut[-1][0]} {gone}_rows_offloaded>>"}}'
        return "[" + ",".join([t for t, stay in zip(texts, kept) if stay]) + note + "]", gone > 0

    def _group(self, items: list, texts: list[str], kind: str, mixed: bool) -> tuple[str | None, list[bool]]:
        """(the table that stands for items of one type, or None, and which of them stay)."""
        n = len(items)
        judged = items if kind == "string" else texts
        k = optimal_k(judged, self.bias)
        if n <= adaptive.WHOLE or (kind == "dict" and n <= k):
            return None, [True] * n
        if kind == "dict":
            if self.lossless:
                csv = table_of(items)[0]
                if 1.0 - len(csv.encode()) / (sum(len(t.encode()) for t in texts) + n + 1) >= LEAST_SAVED:
                    return csv, [True] * n
            must = _odd(items, texts)
            kept = [w != "dropped" for w in sampled(texts, must, list(map(int, must)), k)]
            same = [dump(x, True) for x in items]
            return None, self._like(same, kept) if mixed else self._firsts(same, kept)
        if kind == "string":
            error, (odd, _) = _errors(texts), _away([float(len(x)) for x in items])
            why = sampled(items, [a or b for a, b in zip(error, odd)], [a + b for a, b in zip(error, odd)], k)
            kept = [w != "dropped" for w in why]
            return None, self._like(texts, kept) if mixed else kept
        xs = [float(x) for x in items]
        odd, deviation = _away(xs)
        turn = [False] * n if mixed else _turns(xs, deviation)
        why = sampled(texts, [a or b for a, b in zip(odd, turn)], list(map(int, odd)), k, False)
        # numbers of mixed arrays keep ends and outliers only
        return None, [w in ("marked", "edge") if mixed else w != "dropped" for w in why]

    @staticmethod
    def _firsts(same: list[str], kept: list[bool]) -> list[bool]:
        """Of equal items the first stays."""
        seen: set[str] = set()
        return [stay and not (s in seen or seen.add(s)) for s, stay in zip(same, kept)]

    @staticmethod
    def _like(same: list[str], kept: list[bool]) -> list[bool]:
        """All items that equal a kept one stay."""
        held = {s for s, stay in zip(same, kept) if stay}
        return [s in held for s in same]
