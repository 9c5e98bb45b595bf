import random

import pytest

from lodestream.operators import logs, traces

PYTHON = ["Traceback (most recent call last):", '  File "a.py", line 3', "    f()", "ValueError: bad", "", "During handling of the above exception, another occurred:", ""]
FRAMES = {
    "python": PYTHON, "js": ["    at run (/srv/app.js:10:5)", "    at next (/srv/app.js:20:15)", ""], "java": ["\tat com.acme.Run$1.go(Run.java:5)", "\tat com.acme.Main.main(Main.java)", "Caused by: x"],
    "rust": ["  --> src/main.rs:10:5", "--> src/lib.rs:1:2", "   |"], "go": ["1: 0x4a5b main.go", " 22:  0xff", "3 more"],
}
PLAIN = ["INFO started", "lower line", "Upper line", "", " indented", "error: boom", "12 passed", "at home", "File missing", "--> no place", "9: none", "WARN disk 5% full at /var/x/", "=== end ==="]


def sequential(lines):
    """Make and number of each line by the rules in one loop, each stated by itself."""

    def opens(line):
        bare = line.lstrip()
        if bare.startswith("Traceback (most recent call last)") or (bare.startswith('File "') and '", line ' in bare and bare[-1].isdigit()):
            return "python"
        place = any(a.isdigit() and b[:1].isdigit() for a, b in zip([p for p in bare.split(":")][1:], bare.split(":")[2:]) if a.isdigit())
        if bare.startswith("at ") and "(" in bare and ")" in bare and place:
            return "js"
        name = bare[3:].split("(")[0]
        if bare.startswith("at ") and "(" in bare and name and all(c.isascii() and (c.isalnum() or c in "._$") for c in name):
            return "java"
        if bare.startswith("--> ") and place:
            return "rust"
        head, colon, rest = bare.partition(":")
        return "go" if colon and head.isdigit() and rest.lstrip(" ")[:2] == "0x" and rest.lstrip(" ")[2:3] in set("0123456789abcdefABCDEF") - {""} else None

    def ends(make, line):
        bare = line.lstrip()
        if make == "python":
            return not (line == "" or line[0] in " \t" or bare.startswith(("Traceback", "File ", "During handling", "The above exception")) or bare[:1].isupper())
        return line != "" and not {"js": bare.startswith("at "), "java": bare.startswith("at "), "rust": bare.startswith("--> "), "go": bare[:1].isdigit()}[make]

    make, n, out = None, 0, []
    for line in lines:
        if make and n < 20 and not ends(make, line):
            n += 1
        else:
            make, n = opens(line), 1
        out.append((make, n if make else None))
    return out


def log(seed, size):
    r, out = random.Random(seed), []
    while len(out) < size:
        make = r.choice([*FRAMES, None, None])
        out += r.choices(FRAMES[make], k=r.randrange(1, 30)) if make and r.random() < 0.3 else FRAMES[make] if make else r.choices(PLAIN, k=r.randrange(1, 5))
    return out[:size]


@pytest.mark.parametrize("seed", range(20))
def test_machine_equals_the_loop(seed):
    lines = log(seed, 300)
    got = [divmod(s - 1, 20) if s else None for s in traces.labelled([traces.symbol(x) for x in lines])]
    assert [(traces.MAKES[g[0]], g[1] + 1) if g else (None, None) for g in got] == sequential(lines)


def test_state_maps_equal_steps():
    maps = traces._maps()
    assert maps.shape == (96, 101)
    r = random.Random(1)
    symbols = [traces.symbol(x) for x in log(3, 200)]
    state = list(range(101))
    for s in symbols:
        state = [int(maps[s][x]) for x in state]
    for _ in range(20):
        start = r.randrange(101)
        assert traces.labelled(symbols, start)[-1] == state[start]


@pytest.mark.parametrize("chunk", [1, 7, 64, 4096])
def test_chunks_equal_one_pass(spark, chunk):
    logs_ = {k: log(k, n) for k, n in ((1, 1), (2, 150), (3, 64), (4, 129))}
    rows = [(k, p, x or None) for k, lines in logs_.items() for p, x in enumerate(lines)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, at long, line string").repartition(4)
    got = {(r.id, r.at): (r.trace, r.nth) for r in traces.trace_lines(df, chunk).collect()}
    assert got == {(k, p): x for k, lines in logs_.items() for p, x in enumerate(sequential(lines))}


def test_one_log_is_spread_over_tasks(spark):
    """A log of 40,000 lines as one id: its chunks are dealt out."""
    from pyspark.sql import functions as F

    lines = log(9, 1000)
    df = spark.range(40_000).select(F.lit(1).alias("id"), F.col("id").alias("at")).join(spark.createDataFrame(list(enumerate(lines)), "k long, line string"), F.col("at") % 1000 == F.col("k")).drop("k")
    got = {r.at: (r.trace, r.nth) for r in traces.trace_lines(df, 1000).collect()}
    assert [got[p] for p in range(40_000)] == sequential(lines * 40)


def test_levels_and_formats():
    assert [logs.level(x) for x in ("2024 ERROR x", "errors", "a Failed b", "Warning: x", "xINFO", "[info]", "TRACE", "fatal_x", "no critical")] == ["error", None, "fail", "warn", None, "info", "trace", None, "error"]
    assert logs.log_format(["collected 5 items", "a PASSED [ 5%]"]) == "pytest" and logs.log_format(["npm ERR! x"]) == "npm" and logs.log_format(["   Compiling x"]) == "cargo"
    assert logs.log_format(["x"]) == "generic" and logs.log_format(["PASS a"]) == "jest" and logs.log_format(["make: *** x"]) == "make"
    assert logs.warning_key("warn 12: at 0x12 in /a/b/c 5") == logs.warning_key("warn 12: at 0x77 in /d/c 9") != logs.warning_key("warn 13: at 0x12 in /a/b/c 5")


def test_compressed_logs(spark):
    body = [f"line {k}" for k in range(200)]
    body[50] = "ERROR one"
    body[100:107] = PYTHON
    body[150:152] = ["WARN x: 1", "WARN x: 2"]
    body[199] = "=== 3 passed ==="
    text = "\n".join(body)
    rows = spark.createDataFrame([(1, text), (2, "short\nlog"), (3, None), (4, "\n" * 60), (5, "\n".join(f"ERROR {k}" for k in range(300)))], "id long, t string")
    got = {r.id: r for r in logs.compressed(rows, "id", "t").collect()}
    assert set(got) == {1, 2, 4, 5}
    assert (got[2].text, got[2].kept_lines, got[2].key) == ("short\nlog", 2, None)
    want = [*range(47, 54), *range(97, 110), *range(147, 154), *range(196, 200)]
    lines = got[1].text.split("\n")
    assert lines[: got[1].kept_lines] == [body[k] for k in want]
    assert lines[-2:] == [f"[{200 - len(want)} lines omitted: 1 ERROR, 2 WARN]", f"[200 lines compressed to {len(want)}. Retrieve more: hash={got[1].key}]"]
    assert got[4].kept_lines == 0 and got[5].kept_lines <= 100 and got[5].text.startswith("ERROR 0\n")
    assert "ERROR 299" in got[5].text.split("\n")


def test_recorded_results():
    """A log of seventy lines, as it was recorded: the error with its surroundings, the trace, and what was left out."""
    body = [f"INFO step {k}" for k in range(70)]
    body[30] = "ERROR broke"
    kept, counts = logs.chosen(body)
    assert kept == list(range(27, 34)) and counts == {"error": 1, "fail": 0, "warn": 0, "info": 69}
    text, n, of, kind, key = logs._compressed("\n".join(body), 50, 0.5, {})
    assert text.endswith(f"\n[63 lines omitted: 1 ERROR, 69 INFO]\n[70 lines compressed to 7. Retrieve more: hash={key}]") and (n, of, kind) == (7, 70, "generic")
