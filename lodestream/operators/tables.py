"""Arrays of objects as tables: schema line and rows inferred from the objects, arrays within cells as tables of their own.

A cell is a row (table, at, field, ...); table names the array, at the object's place. Columns, their types and which of
them open into columns of their own are aggregates over an array's cells, lines are aggregates over a row's; tables in
cells are rendered first, deepest first, so nothing but a rendered cell is ever held.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestream.session import written

#: Most keys of an object that opens into columns, and bytes above which a string is opaque.
MOST_INNER, OPAQUE_BYTES = 6, 256
#: Deepest nesting of JSON that is read.
NESTING = 128

#: Columns of a cell: what it is called, its type, its text in a line and in JSON, the table that it holds, its inner cells.
_TEXTS = "tag string, empty boolean, csv string, json string"
CELL = (
    f"table string, at long, level int, field string, {_TEXTS}, child string, "
    "inner array<struct<field:string,tag:string,empty:boolean,csv:string,json:string>>"
)


class Number(str):
    """A number as it is written."""


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse)


def load(text: str, containers_only: bool = False) -> object:
    """The value of a JSON text, numbers as they are written; None if it isn't JSON or nested too deeply.

    With containers_only, texts of scalars count as no JSON.
    """
    if containers_only and text.lstrip()[:1] not in ("{", "["):
        return None
    try:
        value = _DECODER.decode(text)
        # as deep as there are brackets at most
        level, depth = [value] if text.count("{") + text.count("[") >= NESTING else [], 0
        while level:
            depth += 1
            level = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
            if depth > NESTING:
                return None
        if "\\u" in text:  # half a character, which is no text, can only be written so
            dump(value).encode()
        return value
    except (ValueError, RecursionError):
        return None


def dump(value: object, sort: bool = False) -> str:
    """Compact JSON with numbers as they were written."""
    kind = type(value)
    if kind is Number:
        return str(value)
    if kind is str:
        return encode_basestring(value)
    if kind is dict:
        return "{" + ",".join([f"{encode_basestring(k)}:{dump(v, sort)}" for k, v in (sorted(value.items()) if sort else value.items())]) + "}"
    if kind is list:
        return "[" + ",".join([dump(v, sort) for v in value]) + "]"
    return json.dumps(value, ensure_ascii=False)


def opaque_kind(text: str) -> str | None:
    """base64, html or string for texts that are too long to stay; None for others."""
    raw = text.encode()
    if len(raw) <= OPAQUE_BYTES:
        return None
    alphabet = sum(c.isascii() and c.isalnum() or c in "+/=_-" for c in text)
    if not any(c in "<>" or c.isspace() for c in text) and alphabet / len(raw) >= 0.95 and len(set(text)) >= 16:
        return "base64"
    opens = sum(a == "<" and (b.isascii() and b.isalpha() or b in "/!") for a, b in zip(text, text[1:]))
    return "html" if opens >= 3 else "string"


def _human(n: int) -> str:
    if n < 1024:
        return f"{n}B"
    return f"{n / 1024:.1f}KB" if n < 1024 * 1024 else f"{n / 1024 / 1024:.1f}MB"


def marker(text: str) -> str:
    """What stands for a long string."""
    return f"<<ccr:{hashlib.sha256(text.encode()).hexdigest()[:12]},{opaque_kind(text)},{_human(len(text.encode()))}>>"


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


#: Characters for which a cell is quoted in a line.
_SPECIAL = re.compile('[,"\n\r]')
#: How Spark writes characters of a string as JSON.
_ESCAPED = {k: f"\\u{k:04X}" for k in range(32)} | {ord(c): "\\" + e for c, e in zip('"\\\b\t\n\f\r', '"\\btnfr')}


def as_spark(text: str) -> str:
    """A string as JSON, in the form in which `to_json` writes it."""
    return '"' + text.translate(_ESCAPED) + '"'


def _scalar(value: object) -> dict:
    """Type and texts of a value that isn't looked into."""
    if value is None:
        return {"tag": "null", "empty": True, "csv": "", "json": "null"}
    if isinstance(value, Number):
        whole = value.lstrip("-").isdigit() and (len(value) < 19 or -(2**63) <= int(value) < 2**64)
        return {"tag": "int" if whole else "float", "empty": False, "csv": str(value), "json": str(value)}
    if isinstance(value, bool):
        return {"tag": "bool", "empty": False, "csv": dump(value), "json": dump(value)}
    if isinstance(value, str):
        return {"tag": "string", "empty": False, "csv": _quoted(value) if _SPECIAL.search(value) else value, "json": dump(value)}
    return {"tag": "json", "empty": False, "csv": _quoted(dump(value)), "json": dump(value)}


def cells_of(item: dict, table: str, at: int, level: int = 0) -> Iterator[dict]:
    """Cells of one object, and those of the tables that its cells hold."""
    for k, (field, value) in enumerate(item.items()):
        cell = {"table": table, "at": at, "level": level, "field": field, **_scalar(value)}
        tag, parsed = cell["tag"], value
        if isinstance(value, str) and not isinstance(value, Number):
            inner = load(value, containers_only=True)
            if inner is not None:
                parsed = inner
                cell |= _scalar(inner) | {"tag": tag}
            elif kind := opaque_kind(value):
                own = marker(value)
                cell |= {"csv": own, "json": dump({"_ccr": own[6:18], "_size": Number(len(value.encode())), "_kind": kind})}
        if isinstance(parsed, dict):
            cell["inner"] = [{"field": f, **_scalar(v)} for f, v in parsed.items()]
        if isinstance(parsed, list) and len(parsed) >= 2 and all(isinstance(x, dict) for x in parsed):
            child = f"{table}/{at}/{k}"
            cell["child"] = child
            for j, x in enumerate(parsed):
                yield {"table": child, "at": j, "level": level + 1}
                yield from cells_of(x, child, j, level + 1)
        yield cell


def table_of(items: list[dict]) -> tuple[str, str]:
    """(csv, json) of one array of objects that a task holds, as `tables` gives them."""
    have: dict[str, list[tuple]] = {}  # the place of each value of a field, the value, and what it is read as
    for p, item in enumerate(items):
        for field, value in item.items():
            inner = load(value, containers_only=True) if type(value) is str else None
            have.setdefault(field, []).append((p, value, value if inner is None else inner))
    head, schema, columns = [], [], []
    for field in sorted(have, key=lambda f: (-len(have[f]), f.encode())):
        values, missing = have[field], len(have[field]) < len(items)
        keys = {tuple(read) if type(read) is dict else None for _, _, read in values}
        opens = len(keys) == 1 and None not in keys and 1 <= len(next(iter(keys))) <= MOST_INNER and "." not in field
        for key in next(iter(keys)) if opens else (None,):
            cells = [_scalar(read[key]) for _, _, read in values] if opens else [_cell(value, read) for _, value, read in values]
            tags = {x["tag"] for x in cells if not x["empty"]}
            tag = "string" if not tags else tags.pop() if len(tags) == 1 else "json"
            nullable = missing or any([x["empty"] for x in cells])
            name = f"{field}.{key}" if opens else field
            head.append(f"{name}:{tag}{'?' if nullable else ''}")
            schema.append('{"name":' + as_spark(name) + f',"type":"{tag}"' + (',"nullable":true}' if nullable else "}"))
            column: list[dict] = [_MISSING] * len(items)
            for (p, _, _), cell in zip(values, cells):
                column[p] = cell
            columns.append(column)
    rows = list(zip(*columns)) or [()] * len(items)
    n = len(items)
    csv = f"[{n}]{{{','.join(head)}}}\n" + "".join([",".join([x["csv"] for x in row]) + "\n" for row in rows])
    body = ",".join(["[" + ",".join([x["json"] for x in row]) + "]" for row in rows])
    return csv, f'{{"_compaction":"table","_schema":[{",".join(schema)}],"_kept":{n},"_total":{n},"_rows":[{body}]}}'


#: The texts of a cell that a row lacks.
_MISSING = {"csv": "", "json": "null"}


def _cell(value: object, read: object) -> dict:
    """Type and texts of a value that is read as another if it is a string that holds JSON, as in `cells_of`."""
    if read is not value:
        cell = _scalar(read) | {"tag": "string"}
    else:
        cell = _scalar(value)
        if type(value) is str and (kind := opaque_kind(value)):
            own = marker(value)
            cell |= {"csv": own, "json": dump({"_ccr": own[6:18], "_size": Number(len(value.encode())), "_kind": kind})}
    if type(read) is list and len(read) >= 2 and all(type(x) is dict for x in read):
        nested = table_of(read)[1]
        cell |= {"csv": _quoted(nested), "json": nested}
    return cell


def cells(items: DataFrame, table: str, at: str, item: str) -> DataFrame:
    """Cells of the objects in `item` (JSON text), which are the rows of their table; other texts have none. Each is read once."""
    schema = to_arrow_schema(StructType.fromDDL(CELL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, place, text in zip(*(batch.column(c).to_pylist() for c in ("table", "at", "item"))):
                value = load(text) if text is not None else None
                if isinstance(value, dict):
                    found += cells_of(value, name, place)
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    slim = items.select(F.col(table).cast("string").alias("table"), F.col(at).cast("long").alias("at"), F.col(item).alias("item"))
    return written(slim.mapInArrow(run, CELL), "cells")


def _columns(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """table, column (from 1), field, inner, name, tag, nullable: columns by how many rows have them, then by name.

    A field whose cells are all objects with the same few keys opens into a column for each key.
    """
    keys = F.transform("inner", lambda x: x["field"])
    by_field = cells.groupBy("table", "field").agg(
        F.count("*").alias("have"), F.count("inner").alias("objects"), F.min(keys).alias("keys"), F.max(keys).alias("most"), F.max("empty").alias("nulls"),
        F.array_distinct(F.collect_set(F.when(~F.col("empty"), F.col("tag")))).alias("tags"),
    ).join(sizes, "table")
    opens = (F.col("objects") == F.col("have")) & (F.col("keys") == F.col("most")) & F.size("keys").between(1, MOST_INNER) & ~F.contains("field", F.lit("."))
    by_field = by_field.withColumn("opens", F.coalesce(opens, F.lit(False)))
    one = lambda tags: F.when(F.size(tags) == 0, "string").when(F.size(tags) == 1, F.get(tags, F.lit(0))).otherwise("json")
    parts = F.when(F.col("opens"), F.col("keys")).otherwise(F.array(F.lit(None).cast("string")))
    columns = by_field.select("table", "field", "have", "n", "opens", "nulls", one(F.col("tags")).alias("tag"), F.posexplode(parts).alias("k", "inner"))
    inner = cells.join(by_field.where("opens").select("table", "field"), ["table", "field"], "left_semi").select("table", "field", F.explode("inner").alias("x"))
    inner = inner.groupBy("table", "field", F.col("x.field").alias("inner")).agg(F.collect_set(F.when(~F.col("x.empty"), F.col("x.tag"))).alias("inner_tags"), F.max("x.empty").alias("inner_nulls"))
    columns = columns.where("opens").join(inner, ["table", "field", "inner"]).unionByName(columns.where("not opens"), allowMissingColumns=True).select(
        "table", "field", "inner", "have", "k",
        F.when(F.col("opens"), F.concat("field", F.lit("."), "inner")).otherwise(F.col("field")).alias("name"),
        F.when(F.col("opens"), one(F.col("inner_tags"))).otherwise(F.col("tag")).alias("tag"),
        ((F.col("have") < F.col("n")) | F.coalesce(F.when(F.col("opens"), F.col("inner_nulls")).otherwise(F.col("nulls")), F.lit(False))).alias("nullable"),
    )
    order = W.partitionBy("table").orderBy(F.desc("have"), "field", "k")
    return columns.withColumn("column", F.row_number().over(order)).drop("have", "k")


def _lines(cells: DataFrame, columns: DataFrame, rows: DataFrame, widths: DataFrame) -> DataFrame:
    """table, at, csv, json: the line of each row, missing cells empty or null."""
    inner = F.get(F.filter("inner", lambda x: x["field"] == F.col("inner_key")), F.lit(0))
    opened = F.struct(inner["csv"].alias("csv"), inner["json"].alias("json"))
    found = F.when(F.col("inner_key").isNull(), F.struct("csv", "json")).otherwise(opened)
    each = cells.join(columns.select("table", "field", F.col("inner").alias("inner_key"), "column"), ["table", "field"]).withColumn("cell", found)
    held = each.groupBy("table", "at").agg(F.map_from_entries(F.collect_list(F.struct("column", "cell"))).alias("cells"))
    full = rows.select("table", "at").join(held, ["table", "at"], "left").join(widths, "table")

    def texts(name: str, missing: str) -> Column:
        of = F.transform(F.sequence(F.lit(1), F.col("width")), lambda k: F.coalesce(F.try_element_at("cells", k)[name], F.lit(missing)))
        return F.when(F.col("width") > 0, F.array_join(of, ",")).otherwise("")

    return full.select("table", "at", texts("csv", "").alias("csv"), F.concat(F.lit("["), texts("json", "null"), F.lit("]")).alias("json"))


def _parts(cells: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, n, width, head, schema) and (table, at, csv, json) of tables whose cells have their texts."""
    sizes = rows.groupBy("table").agg(F.count("*").alias("n"))
    columns = written(_columns(cells, sizes), "table-columns")
    name = F.col("name")
    as_json = F.concat(F.lit('{"name":'), _json_string(name), F.lit(',"type":"'), "tag", F.when(F.col("nullable"), F.lit('","nullable":true}')).otherwise(F.lit('"}')))
    in_order = lambda of: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", of.alias("text")))), lambda x: x["text"]), ",")
    heads = columns.groupBy("table").agg(
        in_order(F.concat(name, F.lit(":"), "tag", F.when(F.col("nullable"), "?").otherwise(""))).alias("head"), in_order(as_json).alias("schema"), F.count("*").cast("int").alias("width")
    )
    heads = sizes.join(heads, "table", "left").fillna("", ["head", "schema"]).fillna(0, ["width"])
    return heads, _lines(cells, columns, rows, heads.select("table", "width"))


def _rendered(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """table, csv, json of tables whose cells have their texts."""
    heads, lines = _parts(cells, rows)
    body = lambda of, end: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(of).alias("text")))), lambda x: x["text"]), end)
    bodies = lines.groupBy("table").agg(body("csv", "\n").alias("lines"), body("json", ",").alias("rows"))
    n = F.col("n").cast("string")
    csv = F.concat(_header(), F.lit("\n"), "lines", F.lit("\n"))
    as_table = F.concat(F.lit('{"_compaction":"table","_schema":['), "schema", F.lit('],"_kept":'), n, F.lit(',"_total":'), n, F.lit(',"_rows":['), "rows", F.lit("]}"))
    return heads.join(bodies, "table").select("table", csv.alias("csv"), as_table.alias("json"))


def _header() -> Column:
    return F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]{"), "head", F.lit("}"))


def _json_string(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _outermost(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells of the tables named in `rows`, with the tables in them rendered, the deepest first."""
    wanted = rows.select("table").distinct()
    deepest = cells.agg(F.max("level")).collect()[0][0] or 0
    done = None
    for level in range(deepest, -1, -1):
        here = cells.where((F.col("level") == level) & F.col("field").isNotNull())
        here = here.join(wanted, "table", "left_semi") if level == 0 else here
        if done is not None:
            inner = done.select(F.col("table").alias("child"), F.col("json").alias("nested"))
            in_line = F.concat(F.lit('"'), F.replace("nested", F.lit('"'), F.lit('""')), F.lit('"'))
            here = here.join(inner, "child", "left").withColumn("csv", F.coalesce(in_line, "csv")).withColumn("json", F.coalesce("nested", "json"))
        here = written(here.select("table", "at", "field", "tag", "empty", "csv", "json", "inner"), "table-cells")
        if level:
            done = written(_rendered(here, cells.where((F.col("level") == level) & F.col("field").isNull()).select("table", "at")), "tables")
    return here


def tables(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """table, csv, json: the tables whose rows are named in `rows` (table, at), with the tables in their cells.

    csv is a line `[rows]{name:type,...}` (`?` after the type of a column that some row lacks) and a line for each row;
    json is the form that tables in cells take. Cells of tables that aren't asked for are left out.
    """
    return written(_rendered(_outermost(cells, rows), rows.select("table", "at")), "tables")


def table_lines(cells: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, n, header) and (table, at, line): as `tables`, for tables that may be larger than a cell."""
    heads, lines = _parts(_outermost(cells, rows), rows.select("table", "at"))
    heads, lines = heads.select("table", "n", _header().alias("header")), lines.select("table", "at", F.col("csv").alias("line"))
    return written(heads, "table-heads"), written(lines, "table-lines")
