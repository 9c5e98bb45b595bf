import hashlib
import json
import random
import statistics

import pytest

from lodestream.operators import tables, trees
from lodestream.operators.tables import Number, dump, load
from tests.test_adaptive import brute_k, brute_sample

KEYWORDS = trees.ERROR_KEYWORDS


def marker(text):
    return tables.marker(text)


def is_error(text):
    return any(k in text.lower() for k in KEYWORDS)


def scalar(v):
    x = tables._scalar(v)
    return x["tag"], x["empty"], x["csv"], x["json"]


def brute_table(items):
    """(csv, json) of an array of objects, by the rule in one piece."""
    have = {}
    for x in items:
        for k in x:
            have[k] = have.get(k, 0) + 1
    fields = sorted(have, key=lambda k: (-have[k], k.encode()))
    columns = []  # (name, tag, nullable, cell of an object)

    def one(tags):
        return "string" if not tags else tags.pop() if len(tags) == 1 else "json"

    def parsed(v):
        inner = load(v, containers_only=True) if isinstance(v, str) and not isinstance(v, Number) else None
        return v if inner is None else inner

    def cell(v):
        p = parsed(v)
        if isinstance(p, list) and len(p) >= 2 and all(isinstance(x, dict) for x in p):
            inner = brute_table(p)[1]
            return '"' + inner.replace('"', '""') + '"', inner
        if isinstance(v, str) and not isinstance(v, Number) and p is v and tables.opaque_kind(v):
            m = marker(v)
            return m, dump({"_ccr": m[6:18], "_size": Number(len(v.encode())), "_kind": tables.opaque_kind(v)})
        return scalar(p)[2:]

    for f in fields:
        values = [x[f] for x in items if f in x]
        keys = {tuple(parsed(v)) if isinstance(parsed(v), dict) else None for v in values}
        if len(keys) == 1 and None not in keys and 1 <= len(next(iter(keys))) <= 6 and "." not in f:
            for k in next(iter(keys)):
                inner = [parsed(v)[k] for v in values]
                tags = {scalar(v)[0] for v in inner if v is not None}
                nullable = len(values) < len(items) or any(v is None for v in inner)
                columns.append((f"{f}.{k}", one(tags), nullable, lambda x, f=f, k=k: scalar(parsed(x[f])[k])[2:] if f in x else ("", "null")))
        else:
            tags = {scalar(v)[0] for v in values if v is not None}
            nullable = len(values) < len(items) or any(v is None for v in values)
            columns.append((f, one(tags), nullable, lambda x, f=f: cell(x[f]) if f in x else ("", "null")))
    head = ",".join(f"{n}:{t}{'?' * q}" for n, t, q, _ in columns)
    lines = "".join(",".join(c(x)[0] for *_, c in columns) + "\n" for x in items)
    schema = ",".join('{"name":' + dump(n) + f',"type":"{t}"' + ',"nullable":true' * q + "}" for n, t, q, _ in columns)
    rows = ",".join("[" + ",".join(c(x)[1] for *_, c in columns) + "]" for x in items)
    n = len(items)
    return f"[{n}]{{{head}}}\n{lines}", f'{{"_compaction":"table","_schema":[{schema}],"_kept":{n},"_total":{n},"_rows":[{rows}]}}'


def strays(xs):
    if len(xs) < 2 or not statistics.stdev(xs):
        return [False] * len(xs)
    m, s = sum(xs) / len(xs), statistics.stdev(xs)
    return [abs(x - m) > 2 * s for x in xs]


def cut_objects(items, lossless):
    """Items that stay, as places, or the text of their table."""
    texts = [dump(x) for x in items]
    k = brute_k(texts, max_k=15)
    if len(items) <= k:
        return list(range(len(items)))
    if lossless:
        table = brute_table(items)[0]
        if 1 - len(table.encode()) / (sum(len(t.encode()) for t in texts) + len(texts) + 1) >= 0.15:
            return table
    must = [is_error(t) for t in texts]
    fields = {f for x in items for f in x}
    for f in fields:
        at = [p for p, x in enumerate(items) if f in x]
        if len(at) < 0.2 * len(items):
            for p in at:
                must[p] = True
        numbers = [p for p in at if isinstance(items[p][f], Number)]
        for p, odd in zip(numbers, strays([float(items[p][f]) for p in numbers])):
            must[p] |= odd
    why = brute_sample(texts, must, must, k, True)
    seen, out = set(), []
    for p, w in enumerate(why):
        if w != "dropped" and dump(items[p], True) not in seen:
            seen.add(dump(items[p], True))
            out.append(p)
    return out


def cut_strings(items):
    k = brute_k(items, max_k=15)
    odd = strays([float(len(x)) for x in items])
    error = [is_error(dump(x)) for x in items]
    return [p for p, w in enumerate(brute_sample(items, [a or b for a, b in zip(error, odd)], [a + b for a, b in zip(error, odd)], k, True)) if w != "dropped"]


def brute(value, depth=0, lossless=True):
    """(value, changed) by recursion; rendered tables are strings."""
    if depth >= 50:
        return value, False
    if isinstance(value, list):
        kind, n = trees.array_kind(value), len(value)
        if n >= 5 and kind == "dicts":
            kept = cut_objects(value, lossless)
            if isinstance(kept, str):
                return kept, True
            if len(kept) == n:
                return value, False
            digest = hashlib.sha256(dump(value).encode()).hexdigest()[:12]
            return [value[p] for p in kept] + [{"_ccr_dropped": f"<<ccr:{digest} {n - len(kept)}_rows_offloaded>>"}], True
        if n >= 5 and kind == "strings":
            kept = cut_strings(value)
            return [value[p] for p in kept], len(kept) < n
        if n >= 5 and kind == "numbers":
            xs = [float(x) for x in value]
            out = strays(xs)
            turn = [False] * n
            if n > 10 and statistics.stdev(xs):
                for p in range(5, n - 5):
                    turn[p] = abs(sum(xs[p : p + 5]) / 5 - sum(xs[p - 5 : p]) / 5) > 2 * statistics.stdev(xs)
            texts = [str(x) for x in value]
            why = brute_sample(texts, [a or b for a, b in zip(out, turn)], out, brute_k(texts, max_k=15), False)
            kept = [p for p in range(n) if why[p] != "dropped"]
            return [value[p] for p in kept], len(kept) < n
        if n >= 5 and kind == "mixed":
            if n <= 8:
                return value, False
            kept, groups = set(), {}
            for p, x in enumerate(value):
                groups.setdefault(trees.item_kind(x), []).append(p)
            for own, at in groups.items():
                xs = [value[p] for p in at]
                if len(at) < 5 or own not in ("dict", "str", "number"):
                    kept |= set(at)
                elif own == "dict":
                    stay = cut_objects(xs, lossless)
                    same = {dump(xs[p], True) for p in (range(len(xs)) if isinstance(stay, str) else stay)}
                    kept |= {p for p in at if dump(value[p], True) in same}
                elif own == "str":
                    same = {xs[p] for p in cut_strings(xs)}
                    kept |= {p for p in at if value[p] in same}
                else:
                    k = brute_k([str(x) for x in xs], max_k=15)
                    first = min(max(1, round(k * 0.3)), k)
                    last = min(max(1, round(k * 0.15)), k - first)
                    odd = strays([float(x) for x in xs])
                    kept |= {p for i, p in enumerate(at) if len(at) <= 8 or i < first or i >= len(at) - last or odd[i]}
            return [value[p] for p in sorted(kept)], len(kept) < n
        parts = [brute(x, depth + 1, lossless) for x in value]
        return [p for p, _ in parts], any(c for _, c in parts)
    if isinstance(value, dict):
        parts = {k: brute(v, depth + 1, lossless) for k, v in value.items()}
        out, changed = {k: p for k, (p, _) in parts.items()}, any(c for _, c in parts.values())
        tokens = {k: len(dump(v).encode()) // 4 + len(k.encode()) // 4 + 2 for k, v in out.items()}
        if len(out) > 8 and sum(tokens.values()) >= 200:
            keys = list(out)
            k = brute_k([f"{key}: {dump(out[key])}" for key in keys], max_k=15)
            if k < len(keys):
                error = [is_error(dump(out[key])) for key in keys]
                must = [e or tokens[key] <= 12 for e, key in zip(error, keys)]
                why = brute_sample(keys, must, error, k, False)
                if "dropped" in why:
                    return {key: out[key] for key, w in zip(keys, why) if w != "dropped"}, True
        return out, changed
    if isinstance(value, str) and not isinstance(value, Number):
        inner = load(value, containers_only=True)
        if inner is not None:
            out, changed = brute(inner, depth + 1, lossless)
            return (value if not changed else out if isinstance(out, str) else dump(out)), changed
        if tables.opaque_kind(value):
            return marker(value), True
    return value, False


def nested(levels, leaf):
    for k in range(levels):
        leaf = {"down": leaf} if k % 2 else [leaf]
    return leaf


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    words = "alpha beta gamma delta epsilon zeta error note".split()
    phrase = lambda n: " ".join(r.choice(words) for _ in range(n))
    record = lambda k: {"id": k, "msg": phrase(3), "at": {"x": k, "y": r.choice([None, 1.5])}, **({"rare": 1} if k % 13 == 0 else {}), "props": json.dumps({"k": k})}
    values = {
        "numbers": [10, 11, 12] * 6 + [10, 11] + list(range(50, 70)), "mixed": ["start", *range(20), "middle"] + ["end"] * 5,
        "mixed2": [*range(9), {"a": 1}, None, True, [1], *({"b": k, "c": phrase(2)} for k in range(30)), *(phrase(1) for _ in range(12))],
        "same": [{"event": "heartbeat", "ok": True}] * 40, "nulls": [None, True, False, None, True, False, None], "few": [1, 2, 3], "empty": [], "none": {},
        "strings": [f"event {k}: something happened at index {k}" for k in range(25)] + ["short", "an error here"], "bools": [True] * 20,
        "records": [record(k) for k in range(40)], "inner": {"deep": {"deeper": [record(k) for k in range(12)], "text": json.dumps([1] * 30)}, "long": "x y " * 100},
        "lists": [[k, [1] * 12] for k in range(9)], "wide": {f"key{k}": phrase(20) for k in range(30)}, "wide2": {f"k{k}": [phrase(4) for _ in range(12)] if k % 3 else k for k in range(20)},
        "tables": [{"id": k, "items": [{"a": 1, "b": 'q,"r'}, {"a": k}], "o": {"u": k, "v": None}, "s": "plain" if k % 2 else 'a,b "c"\nd'} for k in range(20)],
        "strings in strings": json.dumps({"a": json.dumps([phrase(2) for _ in range(20)]), "b": json.dumps({"c": 1})}), "deep": nested(60, [1] * 30), "shallow": nested(20, [1] * 30),
        "base64": {"blob": "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0NTY3" * 10, "page": "<p>a</p><b>c</b>" * 40, "odd": "{not json" + "x" * 300}, "unicode": [f"日本 {k} é" for k in range(20)],
        "scalar": "just a string", "number": 5, "floats": [1.5, 2e3, 1e-7, 12345678901234567890123] * 6, "dots": [{"a.b": {"c": k}, "d": {}} for k in range(20)],
    }
    out = {k: json.dumps(v, ensure_ascii=k != "unicode") for k, v in values.items()}
    return out | {"not json": "this is not json", "blank": "", "spaced": ' {"a" : [ 1 , 2.50, 1E5 ] } ', "nan": "[NaN]", "null": "null", "too deep": "[" * 200 + "]" * 200, "key twice": '{"a": 1, "b": 2, "a": 3}'}


@pytest.mark.parametrize("lossless", [True, False])
def test_crushing_equals_the_recursive_rule(spark, texts, lossless):
    from lodestream.session import ship_package

    ship_package(spark)
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [("absent", None, "y"), (None, "[1]", "z")], "id string, text string, doc string").repartition(3)
    out, offloaded = trees.crushed(df, "id", "text", lossless=lossless)
    got = {r.doc: (r.crushed, r.changed) for r in out.collect()}
    want = {}
    for k, t in texts.items():
        value = load(t)
        new, changed = (t, False) if value is None and t != "null" else brute(value, 0, lossless)
        want[k] = (t if value is None and t != "null" else dump(new), changed)
    want["absent"] = ("", False)
    for k in want:
        assert got[k] == want[k], k
    assert set(got) == set(want)
    # what markers name comes back exactly, wherever only objects and strings were cut
    back = {r.doc: r.restored for r in trees.restored(out, offloaded).collect()}
    for k in ("nulls", "few", "base64", "key twice", "empty", *(["records", "same"] if not lossless else [])):
        assert back[k] == dump(load(texts[k])), k


def test_recorded_results(spark):
    """Results that were recorded for these inputs."""
    inputs = {
        "numbers": ([10, 11, 12] * 6 + [10, 11] + list(range(50, 70)), "[10,11,12,10,10,10,10,10,10,51,54,57,60,68,69]"),
        "mixed": (["start", *range(20), "middle"] + ["end"] * 5, '["start",0,1,2,3,18,19,"middle","end","end","end","end","end"]'),
        "same": ([{"event": "heartbeat", "ok": True}] * 40, '[{"event":"heartbeat","ok":true},{"_ccr_dropped":"<<ccr:6155f8b8951e 39_rows_offloaded>>"}]'),
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in inputs.items()], "id string, text string")
    out, _ = trees.crushed(df, "id", "text", lossless=False)
    assert {r.doc: r.crushed for r in out.collect()} == {k: want for k, (_, want) in inputs.items()}


def test_no_documents(spark):
    out, offloaded = trees.crushed(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert out.count() == 0 and offloaded.count() == 0


@pytest.mark.parametrize("name", ["crushed_events", "crushed_conversations"])
def test_queries_equal_the_recursive_rule(spark, small, name):
    import __spark_entry__ as entry
    from lodestream.plans import trees as plans

    docs = {"crushed_events": plans.event_documents, "crushed_conversations": plans.conversation_documents}[name](spark, small)
    texts = {r.id: r.text for r in docs.collect()}
    got = {r.id: (r.changed, r.bytes_in, r.bytes_out, r.crushed_md5) for r in entry.queries()[name](spark, small).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        new, changed = brute(load(t))
        text = dump(new)
        assert got[k] == (changed, len(t.encode()), len(text.encode()), hashlib.md5(text.encode()).hexdigest()), k


@pytest.mark.parametrize("lossless", [True, False])
def test_documents_within_rows_equal_those_by_levels(spark, texts, lossless, monkeypatch):
    """Parts of small documents meet no shuffle, and both ways give the same texts and keep the same contents."""
    from lodestream.session import ship_package

    ship_package(spark)
    odd = {"controls": json.dumps([{"a": "\x01\x1f\x7f \"\\/", "b\x0b": f"v{k}"} for k in range(30)]), "half": '{"a": "\\ud800"}', "keys": '{"\\u001f\\t": [' + ",".join(f'"x{k}"' for k in range(20)) + "]}"}
    df = spark.createDataFrame(list((texts | odd).items()), "id string, text string").repartition(3)
    got = []
    for limit in (trees.WITHIN, 0 if lossless else 200):
        monkeypatch.setattr(trees, "WITHIN", limit)
        out, offloaded = trees.crushed(df, "id", "text", lossless=lossless)
        if not got:
            assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got.append(({r.doc: (r.crushed, r.changed) for r in out.collect()}, {tuple(r) for r in offloaded.collect()}))
    assert got[0] == got[1]
    assert set(got[0][0]) == set(texts | odd)
