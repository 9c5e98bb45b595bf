"""JSON documents as trees in rows: crushing of arrays, objects and strings, level by level from the deepest up.

1. `tree` opens each document once: nodes that may be rewritten (objects, arrays, strings that hold JSON, leaves), items
   of arrays that are cut as a whole, and cells of tables, each a row that names its parent.
2. Arrays are cut by how many items they should keep (`adaptive`), each type by its own sampler; arrays of objects are
   first written as a table (`tables`) if that saves enough, since nothing is lost then. Long strings become markers.
3. From the deepest level up each container's text is put together from its children's, large objects losing keys;
   a string that holds JSON takes its rewritten tree, if that differs.

What is cut off is kept under the hash in its marker (`offloaded`), and `restored` puts it back exactly.

Scale: a document of up to WITHIN bytes is crushed by the same rule within its row (`crushing`); nothing smaller than it is shuffled. In larger
ones arrays and tables, wherever they are nested, are cut by joins and aggregates over their rows. A document's text is
a cell of the input and of the result, so one document is what a task must be able to hold. Levels are as many as the
deepest live container has, fifty at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestream.operators import adaptive
from lodestream.operators.crushing import CUT, DEEPEST, ERROR_KEYWORDS, LEAST_ITEMS, LEAST_SAVED, MOST_ITEMS, OBJECT_TOKENS, SMALL_TOKENS, Crusher, array_kind, item_kind
from lodestream.operators.tables import CELL, Number, cells_of, dump, load, marker, opaque_kind, tables
from lodestream.session import small_batches, written

#: Bytes of a document up to which it is crushed within its row.
WITHIN = 1 << 18

_SCHEMA = f"doc string, row string, path string, parent string, depth int, place long, name string, kind string, size long, text string, raw string, {CELL}"


def _rows_of(doc: str, value: object) -> Iterator[dict]:
    """Rows of one document's tree, parents before children."""
    todo: list[tuple] = [(value, "", None, 0, 0, None)]
    while todo:
        value, path, parent, depth, place, name = todo.pop()
        node = {"doc": doc, "row": "node", "path": path, "parent": parent, "depth": depth, "place": place, "name": name}
        if depth >= DEEPEST:
            yield node | {"kind": "value", "text": dump(value)}
        elif isinstance(value, dict):
            yield node | {"kind": "object", "size": len(value)}
            todo += [(v, f"{path}/{k}", path, depth + 1, k, key) for k, (key, v) in enumerate(value.items())]
        elif isinstance(value, list):
            kind = array_kind(value)
            if len(value) >= LEAST_ITEMS and kind in (*CUT.values(), "mixed"):
                yield node | {"kind": kind, "size": len(value)}
                for k, item in enumerate(value):
                    own = item_kind(item)
                    yield node | {
                        "row": "item", "path": f"{path}/{k}", "parent": path, "place": k, "name": kind, "kind": own,
                        "text": dump(item), "raw": item if own == "str" else dump(item, True) if own == "dict" else None,
                    }
                    if own == "dict":
                        yield from ({"doc": doc, "row": "cell", "path": f"{path}/{k}", "place": k, **c} for c in cells_of(item, path, k))
            else:
                yield node | {"kind": "array", "size": len(value)}
                todo += [(v, f"{path}/{k}", path, depth + 1, k, None) for k, v in enumerate(value)]
        elif isinstance(value, str) and not isinstance(value, Number):
            inner = load(value, containers_only=True)
            if inner is not None:
                yield node | {"kind": "json", "size": 1, "text": dump(value)}
                todo.append((inner, f"{path}/0", path, depth + 1, 0, None))
            else:
                opaque = opaque_kind(value) is not None
                yield node | {"kind": "string", "text": dump(marker(value) if opaque else value), "raw": value if opaque else None}
        else:
            yield node | {"kind": "value", "text": dump(value)}


def tree(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of the trees of all texts that are JSON: nodes, items and cells; doc is the id as a string."""

    schema = to_arrow_schema(StructType.fromDDL(_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                value = load(text)
                if value is None and text.strip() != "null":
                    continue
                for row in _rows_of(doc, value):
                    held.append(row)
                    if len(held) >= 5000:
                        yield _batch(held, schema)
                        held = []
        yield _batch(held, schema)

    return docs.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc is not null").mapInArrow(run, _SCHEMA)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _has_error(text: Column) -> Column:
    return F.lower(text).rlike("|".join(ERROR_KEYWORDS))


def _joined(of: Column, order: str = "place") -> Column:
    """Texts of a group in order, with commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), of.alias("text")))), lambda x: x["text"]), ",")


def quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _array_name(doc: str = "doc", path: str = "parent") -> Column:
    return F.concat(F.col(doc), F.lit("\x01"), F.col(path))


def cut_items(items: DataFrame, cells: DataFrame, bias: float = 1.0, lossless: bool = True) -> tuple[DataFrame, DataFrame]:
    """(array, pos, stays of every item, table of the arrays that are written as tables): each type by its own rule.

    Items of a mixed array are cut by type, each group of them as an array of its own; its groups of fewer than five
    items, of booleans, lists and nulls all stay.
    """
    mixed = F.col("name") == "mixed"
    own = F.when(mixed, F.concat("array", F.lit("\x01"), F.col("kind"))).otherwise(F.col("array"))
    sizes = items.groupBy(own.alias("group")).agg(F.count("*").alias("members"), F.max(mixed.cast("int")).alias("mixed"))
    whole = items.where(mixed).groupBy("array").agg(F.count("*").alias("all"))
    cuttable = items.withColumn("group", own).join(sizes, "group").join(whole, "array", "left")
    cuttable = cuttable.where(F.col("kind").isin(*CUT) & (~mixed | ((F.col("members") >= LEAST_ITEMS) & (F.col("all") > adaptive.WHOLE))))
    nth = F.row_number().over(W.partitionBy("group").orderBy("place")) - 1
    dealt = written(cuttable.select(F.col("group").alias("array"), nth.cast("long").alias("pos"), F.col("array").alias("of"), "place", "name", "kind", "text", "raw"), "tree-items")
    judged = dealt.select("array", "pos", F.when(F.col("kind") == "str", F.col("raw")).otherwise(F.col("text")).alias("item"))
    budgets = written(adaptive.optimal_k(judged, bias, max_k=MOST_ITEMS), "tree-budgets")

    # arrays of objects beyond their k: a table if it saves enough
    objects = dealt.where("kind = 'dict'").join(budgets.where("n > k").select("array"), "array", "left_semi")
    bytes_in = objects.groupBy("array", "of", "name").agg((F.sum(F.octet_length("text")) + F.count("*") + 1).alias("bytes_in"))
    as_rows = objects.select(F.col("of").alias("table"), F.col("place").alias("at"))
    rendered = tables(cells, as_rows if lossless else as_rows.where("false"))
    saved = rendered.join(bytes_in.withColumnRenamed("of", "table"), "table").where(F.lit(1.0) - F.octet_length("csv") / F.col("bytes_in") >= LEAST_SAVED)
    saved = written(saved.select("array", "table", "name", "csv"), "tree-tables")

    marks = dealt.join(saved.select("array"), "array", "left_anti")
    error = F.coalesce(_has_error(F.col("text")), F.lit(False))
    strings = adaptive.away(marks.where("kind = 'str'").withColumn("x", F.length("raw").cast("double")), "x")
    strings = strings.select("array", "pos", F.col("raw").alias("item"), (error | F.col("away")).alias("must"), (error.cast("int") + F.col("away").cast("int")).alias("extra"))
    numbers = adaptive.away(marks.where("kind = 'number'").withColumn("x", F.expr("try_cast(text AS double)")), "x")
    turns = adaptive.changes(numbers.where("name = 'numbers'"), "x").withColumn("turn", F.lit(True))
    numbers = numbers.join(turns, ["array", "pos"], "left")
    numbers = numbers.select("array", "pos", F.col("text").alias("item"), (F.col("away") | F.coalesce("turn", F.lit(False))).alias("must"), F.col("away").cast("int").alias("extra"), "name")
    objects = marks.where("kind = 'dict'")
    odd = _odd_objects(objects, cells)
    objects = objects.join(odd, ["array", "pos"], "left").select("array", "pos", F.col("text").alias("item"), (error | F.coalesce("odd", F.lit(False))).alias("must"))
    objects = objects.withColumn("extra", F.col("must").cast("int"))

    single = numbers.drop("name")
    why = adaptive.sampled(strings.unionByName(objects), budgets).unionByName(adaptive.sampled(single, budgets, distinct=False))
    picked = dealt.join(why, ["array", "pos"])
    # numbers of mixed arrays keep ends and outliers only; arrays of objects within their k stay whole
    kept = F.when((F.col("name") == "mixed") & (F.col("kind") == "number"), F.col("why").isin("marked", "edge")).otherwise(F.col("why") != "dropped")
    picked = picked.join(budgets.select("array", "n", "k"), "array").withColumn("kept", kept | (F.col("n") <= adaptive.WHOLE) | ((F.col("kind") == "dict") & (F.col("n") <= F.col("k"))))
    picked = written(picked, "tree-picked")
    same = F.when(F.col("kind") == "dict", F.col("raw")).otherwise(F.col("text"))
    # of equal objects the first stays; in mixed arrays all items that equal a kept one do
    first = picked.where("kept and kind = 'dict' and n > k and name = 'dicts'").groupBy("array", "raw").agg(F.min("pos").alias("first"))
    picked = picked.join(first, ["array", "raw"], "left").withColumn("kept", F.col("kept") & (F.col("first").isNull() | (F.col("first") == F.col("pos"))))
    held = picked.where("kept and name = 'mixed' and kind in ('dict', 'str')").select("array", same.alias("same")).distinct().withColumn("held", F.lit(True))
    picked = picked.withColumn("same", same).join(held, ["array", "same"], "left")
    stays = picked.select(F.col("of").alias("array"), "place", (F.col("kept") | F.coalesce("held", F.lit(False))).alias("kept"))
    return stays, saved


def _odd_objects(objects: DataFrame, cells: DataFrame) -> DataFrame:
    """array, pos, odd of objects with a number far from its field's mean, or a field that few of them have."""
    fields = objects.select("array", "pos", F.col("of").alias("table"), F.col("place").alias("at")).join(cells.select("table", "at", "field", "tag", "json"), ["table", "at"])
    n = objects.groupBy("array").agg(F.count("*").alias("n"))
    rare = fields.groupBy("array", "field").agg(F.count("*").alias("have")).join(n, "array").where(F.col("have") < 0.2 * F.col("n")).select("array", "field")
    numbers = fields.where("tag in ('int', 'float')").withColumn("x", F.expr("try_cast(json AS double)"))
    stats = numbers.groupBy("array", "field").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    far = numbers.join(stats, ["array", "field"]).where((F.col("s") > 0) & (F.abs(F.col("x") - F.col("m")) > 2 * F.col("s"))).select("array", "pos")
    return far.unionByName(fields.join(rare, ["array", "field"], "left_semi").select("array", "pos")).distinct().withColumn("odd", F.lit(True))


def crushed(docs: DataFrame, id_col: str, text_col: str, bias: float = 1.0, lossless: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc, crushed, changed of every row, and hash, content of all that was cut off).

    Texts that are no JSON come back as they are. JSON comes back in compact form: arrays of five or more objects,
    strings, numbers or several types are cut, objects lose keys, long strings become markers, to any depth up to 50.
    Without lossless no array becomes a table.
    Null texts count as empty; rows with a null id have no result, rows that repeat an id are one document: give each
    an id of its own.
    """
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("original"))
    done = written(_within_rows(known, bias, lossless), "tree-rows")
    out = done.where("crushed is not null").select("doc", "crushed", "changed")
    offloaded = done.select(F.explode("cut").alias("c")).select("c.hash", "c.content").distinct()
    large = done.where("crushed is null").select("doc", "original")
    if large.isEmpty():
        return out, offloaded
    more, more_offloaded = _by_levels(large, bias, lossless)
    return out.unionByName(more), offloaded.unionByName(more_offloaded).distinct()


def _within_rows(known: DataFrame, bias: float, lossless: bool) -> DataFrame:
    """doc, crushed, changed, cut (hash, content) of documents of up to WITHIN bytes; of larger ones doc and original alone."""
    ddl = "doc string, original string, crushed string, changed boolean, cut array<struct<hash:string,content:string>>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crusher = Crusher(bias, lossless)
        held: list[dict] = []
        size = 0
        for batch in batches:
            for doc, original, fits in zip(*(batch.column(c) for c in ("doc", "original", "fits"))):
                row = {"doc": doc.as_py()}
                if fits.as_py():
                    row["crushed"], row["changed"] = crusher.document(original.as_py())
                    row["cut"] = [{"hash": h, "content": c} for h, c in crusher.cut]
                else:
                    row["original"] = original.as_py()
                held.append(row)
                size += len(original.as_py())
                if size >= 1 << 22:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    small_batches(known.sparkSession)
    # dealt evenly: the work is a task's own, and rows may come in few files
    dealt = known.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.withColumn("fits", F.octet_length("original") <= WITHIN).mapInArrow(run, ddl)


def _by_levels(known: DataFrame, bias: float, lossless: bool) -> tuple[DataFrame, DataFrame]:
    """As `crushed`, of documents (doc, original) that may be larger than a task holds with all their items."""
    rows = written(tree(known, "doc", "original"), "tree")
    nodes = rows.where("row = 'node'")
    items = rows.where("row = 'item'").withColumn("array", _array_name())
    cells = rows.where("row = 'cell'").withColumn("table", F.concat("doc", F.lit("\x01"), F.col("table")))
    cells = cells.withColumn("child", F.concat("doc", F.lit("\x01"), F.col("child")))
    stays, saved = cut_items(items, cells, bias, lossless)

    stays = written(items.select("array", "doc", "parent", "place", "name", "text").join(stays, ["array", "place"], "left").withColumn("kept", F.coalesce("kept", F.lit(True))), "tree-stays")
    in_table = saved.where("name = 'dicts'").select(F.col("table").alias("array"), "csv")
    whole = stays.groupBy("array", "doc", "parent", "name").agg(
        _joined(F.when(F.col("kept"), F.col("text"))).alias("kept"), _joined(F.col("text")).alias("all"), F.count_if(~F.col("kept")).alias("gone")
    )
    content = F.concat(F.lit("["), "all", F.lit("]"))
    key = F.substring(F.sha2(content.cast("binary"), 256), 1, 12)
    noted = (F.col("name") == "dicts") & (F.col("gone") > 0)
    sentinel = F.concat(F.lit(',{"_ccr_dropped":"<<ccr:'), key, F.lit(" "), F.col("gone").cast("string"), F.lit('_rows_offloaded>>"}'))
    note = F.when(noted, sentinel).otherwise("")
    cut = whole.join(in_table, "array", "left").select(
        "doc", F.col("parent").alias("path"), F.when(F.col("csv").isNotNull(), quoted(F.col("csv"))).otherwise(F.concat(F.lit("["), "kept", note, F.lit("]"))).alias("text"),
        (F.col("csv").isNotNull() | (F.col("gone") > 0)).alias("changed"),
        key.alias("hash"), content.alias("content"), (F.col("csv").isNull() & noted).alias("stored"),
    )
    cut = written(cut, "tree-cut")

    opaque = F.col("raw").isNotNull()
    leaves = nodes.where("kind in ('value', 'string')").select("doc", "parent", "depth", "place", "name", "text", opaque.alias("changed"))
    arrays = nodes.where(F.col("kind").isin("mixed", *CUT.values())).select("doc", "path", "parent", "depth", "place", "name")
    arrays = arrays.join(cut.select("doc", "path", "text", "changed"), ["doc", "path"]).drop("path")
    ready = written(leaves.unionByName(arrays), "tree-ready")
    containers = written(nodes.where("kind in ('object', 'array', 'json')").select("doc", "path", "parent", "depth", "place", "name", "kind", "size", "text"), "tree-containers")
    top = containers.agg(F.max("depth")).collect()[0][0]
    above = ready.where("false")
    for depth in range(-1 if top is None else top, -1, -1):
        children = above.unionByName(ready.where(F.col("depth") == depth + 1))
        above = written(_assembled(containers.where(F.col("depth") == depth), children), f"tree-level-{depth}")
    roots = above.unionByName(ready.where("depth = 0")).select("doc", F.col("text").alias("crushed"), "changed")
    out = known.join(roots, "doc", "left").select("doc", F.coalesce("crushed", "original").alias("crushed"), F.coalesce("changed", F.lit(False)).alias("changed"))
    strings = nodes.where("kind = 'string' and raw is not null").select(F.substring(F.sha2(F.col("raw").cast("binary"), 256), 1, 12).alias("hash"), quoted(F.col("raw")).alias("content"))
    offloaded = cut.where("stored").select("hash", "content").unionByName(strings).distinct()
    return out, offloaded


def _assembled(containers: DataFrame, children: DataFrame) -> DataFrame:
    """The containers of one level with their text, put together from that of their children; large objects lose keys."""
    children = written(children.join(containers.select("doc", F.col("path").alias("parent"), F.col("kind").alias("of"), "size"), ["doc", "parent"]), "tree-children")
    tokens = F.expr("octet_length(text) div 4 + octet_length(name) div 4 + 2")
    large = children.where((F.col("of") == "object") & (F.col("size") > adaptive.WHOLE)).withColumn("array", _array_name()).withColumn("tokens", tokens)
    heavy = large.groupBy("array").agg(F.sum("tokens").alias("all")).where(F.col("all") >= OBJECT_TOKENS).select("array")
    large = written(large.join(heavy, "array", "left_semi").select("array", "doc", "parent", "place", "name", "text", "tokens"), "tree-large")
    children = children.select("doc", "parent", "place", "name", "text", "changed", "of")
    if not large.isEmpty():
        item = F.concat("name", F.lit(": "), "text")
        budgets = written(adaptive.optimal_k(large.select("array", F.col("place").alias("pos"), item.alias("item")), max_k=MOST_ITEMS).where("k < n"), "tree-object-budgets")
        error = _has_error(F.col("text"))
        flagged = large.select("array", F.col("place").alias("pos"), F.col("name").alias("item"), (error | (F.col("tokens") <= SMALL_TOKENS)).alias("must"), error.cast("int").alias("extra"))
        gone = adaptive.sampled(flagged, budgets, distinct=False).where("why = 'dropped'")
        gone = gone.select(F.split("array", "\x01").alias("at"), "pos").select(F.col("at")[0].alias("doc"), F.col("at")[1].alias("parent"), F.col("pos").alias("place"), F.lit(True).alias("gone"))
        children = children.join(gone, ["doc", "parent", "place"], "left")
    else:
        children = children.withColumn("gone", F.lit(None).cast("boolean"))
    gone = F.coalesce("gone", F.lit(False))
    member = F.when(F.col("of") == "object", F.concat(quoted(F.col("name")), F.lit(":"), "text")).otherwise(F.col("text"))
    inner = children.groupBy("doc", F.col("parent").alias("path")).agg(
        _joined(F.when(~gone, member)).alias("inner"), F.max(F.coalesce((F.col("changed") | gone), F.lit(False))).alias("inner_changed"), F.max(F.col("text").startswith('"')).alias("is_string")
    )
    out = containers.join(inner, ["doc", "path"], "left")
    inside, changed = F.coalesce("inner", F.lit("")), F.coalesce("inner_changed", F.lit(False))
    # a string whose tree has changed holds the new text; a tree that became a string itself is taken as it is
    held = F.when(~changed, F.col("text")).when(F.col("is_string"), inside).otherwise(quoted(inside))
    text = F.when(F.col("kind") == "object", F.concat(F.lit("{"), inside, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), inside, F.lit("]"))).otherwise(held)
    return out.select("doc", "parent", "depth", "place", "name", text.alias("text"), changed.alias("changed"))


def restored(crushed_rows: DataFrame, offloaded: DataFrame) -> DataFrame:
    """doc, restored: cut arrays and long strings are put back from what their markers name; tables stay as they are."""
    mark = r"<<ccr:([0-9a-f]{12})[ ,][^<>]*>>"
    named = crushed_rows.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("crushed", F.lit(mark), F.lit(1)))).alias("hash"))
    held = named.join(offloaded, "hash").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("hash", "content"))).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, pairs in zip(batch.column("crushed").to_pylist(), batch.column("held").to_pylist()):
                out.append(_put_back(text, dict(pairs)) if pairs else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.string())], names=["doc", "restored"])

    return crushed_rows.join(held, "doc", "left").select("doc", "crushed", "held").mapInArrow(run, "doc string, restored string")


def _put_back(text: str, held: dict[str, str]) -> str:
    """A crushed document with its markers resolved, also within strings that hold JSON."""
    whole = re.compile(r"<<ccr:([0-9a-f]{12})[ ,][^<>]*>>")

    def walk(value: object) -> object:
        if isinstance(value, list):
            last = value[-1] if value else None
            found = whole.fullmatch(last["_ccr_dropped"]) if isinstance(last, dict) and list(last) == ["_ccr_dropped"] and isinstance(last["_ccr_dropped"], str) else None
            return load(held[found[1]]) if found and found[1] in held else [walk(v) for v in value]
        if isinstance(value, dict):
            return {k: walk(v) for k, v in value.items()}
        if isinstance(value, str) and not isinstance(value, Number):
            found = whole.fullmatch(value)
            if found and found[1] in held:
                return load(held[found[1]])
            inner = load(value, containers_only=True)
            if inner is not None and "<<ccr:" in value:
                return dump(walk(inner))
        return value

    return dump(walk(load(text)))
