"""Deeply nested records to flat tables.

Every node gets an ordinal path (Dewey label): the positions in the child arrays from the outermost inwards. The parent
is the label without its last part, so links need no second pass and no join. Nodes, attributes and marks come out of
one pass over the documents, as rows of one stream that are told apart by ``kind``. A node's schema path (the types from
the outermost to its own) groups it into a table: :func:`table_catalog` lists the tables with their columns, and
:func:`write_tables` lays them out one folder each, linked to the table above by path.

The parse runs in Python over Arrow batches, since documents are recursive JSON text of unknown depth that may be
irregular; it neither shuffles nor collects, and holds one document at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.operators.snapshots import LOCATOR, current_rows

#: Rows of one flat stream. kind: node, attr or mark. name: attribute name or position of the mark.
FLAT = "kind string, path string, parent_path string, pos int, type string, schema_path string, name string, value string"
_FIELDS = [x.split() for x in FLAT.split(", ")]
KINDS = frozenset({"node", "attr", "mark"})
_ROWS_PER_BATCH = 20_000


def fold_keys(pairs: list) -> dict:
    """Keys that matter are read in any case; of keys that differ in case only, the last one counts."""
    out = {}
    for k, v in pairs:
        low = k.lower()
        out[low if low in ("type", "content", "marks", "attrs", "text") else k] = v
    return out


def parse_document(text: str | None) -> dict | None:
    """The JSON object in a text, or in the JSON string that the text is; None for anything else."""
    found = parse_json(text)
    if isinstance(found, str):
        found = parse_json(found)
    return found if isinstance(found, dict) else None


def parse_json(text: str | None):
    """JSON of any depth with folded keys; None for null and for broken text.

    Text that nests deeper than Python's parser goes is read by :func:`parse_deep`.
    """
    if text is None:
        return None
    try:
        return json.loads(text.strip().lstrip("\ufeff"), object_pairs_hook=fold_keys, parse_constant=_refuse)
    except RecursionError:
        return parse_deep(text)
    except ValueError:
        return None


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def parse_deep(text: str):
    """JSON of any depth, with a stack of its own; None where it is broken."""
    scan = json.JSONDecoder(parse_constant=_refuse).scan_once
    text, i, stack, done = text.strip().lstrip("\ufeff"), 0, [], None
    space = " \t\n\r"
    try:
        want_value = True
        while True:
            while i < len(text) and text[i] in space:
                i += 1
            if want_value:
                ch = text[i]
                if ch in "{[":
                    stack.append((ch, [], [None]))
                    i += 1
                    while text[i] in space:
                        i += 1
                    if text[i] == ("}" if ch == "{" else "]"):
                        i, value = i + 1, _close(stack.pop())
                    else:
                        if ch == "{":
                            i = _key(text, i, stack[-1], scan, space)
                        continue
                else:
                    value, i = scan(text, i)
                want_value = False
            if not stack:
                done = value
                break
            ch, items, key = stack[-1]
            items.append((key[0], value) if ch == "{" else value)
            while text[i] in space:
                i += 1
            if text[i] == ",":
                i += 1
                while text[i] in space:
                    i += 1
                if ch == "{":
                    i = _key(text, i, stack[-1], scan, space)
                want_value = True
            elif text[i] == ("}" if ch == "{" else "]"):
                i, value = i + 1, _close(stack.pop())
            else:
                return None
        return done if not text[i:].strip(space) else None
    except (IndexError, StopIteration, ValueError):
        return None


def _key(text: str, i: int, frame: tuple, scan, space: str) -> int:
    if text[i] != '"':
        raise ValueError("a key must be a string")
    frame[2][0], i = scan(text, i)
    while text[i] in space:
        i += 1
    if text[i] != ":":
        raise ValueError("a colon is missing")
    return i + 1


def _close(frame: tuple):
    return fold_keys(frame[1]) if frame[0] == "{" else frame[1]


def _name(value) -> str:
    """A type as text: empty where it is missing, JSON where it is not a string."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value)


def flatten(document: dict, kinds: frozenset[str] = KINDS) -> Iterator[tuple]:
    """Rows of FLAT for each node below the document, its attributes and its marks, in document order; only of ``kinds``."""
    stack = [(document, "", _name(document.get("type")).replace("/", "_"))]
    while stack:
        node, path, schema = stack.pop()
        if path and "node" in kinds:
            up, _, pos = path.rpartition(".")
            yield "node", path, up, int(pos), schema.rpartition("/")[2], schema, None, node["text"] if isinstance(node.get("text"), str) else None
        attrs = node.get("attrs") if "attr" in kinds else None
        if isinstance(attrs, dict):
            for k, v in attrs.items():
                yield "attr", path, path, None, None, schema, k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        marks = node.get("marks") if "mark" in kinds else None
        if path and isinstance(marks, list):
            for i, m in enumerate(marks):
                if isinstance(m, dict):
                    more = m.get("attrs")
                    yield "mark", f"{path}#{i}", path, i, _name(m.get("type")), schema, None, json.dumps(more, ensure_ascii=False) if more else None
        content = node.get("content")
        if isinstance(content, list):
            dot = path + "." if path else ""
            for i in range(len(content) - 1, -1, -1):
                if isinstance(content[i], dict):
                    stack.append((content[i], f"{dot}{i}", f"{schema}/{_name(content[i].get('type')).replace('/', '_')}"))


def flat_rows(df: DataFrame, key: str, document: Column, kinds: frozenset[str] = KINDS) -> DataFrame:
    """(key, *FLAT) of every document, only rows of ``kinds``. NULL, empty and broken documents give no rows; keys may
    repeat or be NULL."""
    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias(key), document.alias("_document")).where("_document IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        keys, rows = [], []

        def out():
            columns = zip(*rows, strict=True) if rows else [[]] * len(_FIELDS)
            arrays = [pa.array(c, pa.int32() if t == "int" else pa.string()) for c, (_, t) in zip(columns, _FIELDS, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys, schema), *arrays], names=[key, *[n for n, _ in _FIELDS]])

        for batch in batches:
            schema = batch.schema.field(0).type
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = parse_document(text.as_py())
                for row in flatten(found, kinds) if found is not None else ():
                    keys.append(k)
                    rows.append(row)
                    if len(rows) >= _ROWS_PER_BATCH:
                        yield out()
                        keys, rows = [], []
        if rows:
            yield out()

    return source.mapInArrow(run, f"`{key}` {kind}, {FLAT}")


def node_table(flat: DataFrame, key: str) -> DataFrame:
    """Nodes with their parent, table (schema path) and text."""
    return flat.where("kind = 'node'").select(key, "path", F.nullif("parent_path", F.lit("")).alias("parent_path"), "pos", "type", "schema_path", F.col("value").alias("text"))


def attribute_table(flat: DataFrame, key: str) -> DataFrame:
    """Attributes of each node (the document's own have an empty path)."""
    return flat.where("kind = 'attr'").select(key, F.col("path").alias("node_path"), "name", "value")


def mark_table(flat: DataFrame, key: str) -> DataFrame:
    """Marks of each node in their order."""
    return flat.where("kind = 'mark'").select(key, F.col("parent_path").alias("node_path"), "pos", "type", F.col("value").alias("attrs"))


def table_name(schema_path: Column) -> Column:
    """Name of the table of a schema path: its last type and a digest of the whole, safe as a folder name."""
    last = F.regexp_replace(F.element_at(F.split(schema_path, "/"), -1), "[^A-Za-z0-9]", "_")
    return F.concat(last, F.lit("_"), F.substring(F.sha2(schema_path, 256), 1, 16))


def table_catalog(flat: DataFrame) -> DataFrame:
    """(schema_path, parent_schema, nodes, attributes): the tables that nodes of one schema path make up.

    ``attributes`` are the names of the columns that a table has besides path, parent and text, in order; parent_schema
    is the table that ``parent_path`` points into, NULL for children of the document. One row per schema path, combined
    map-side, however many nodes a table has.
    """
    own = flat.where("kind IN ('node', 'attr') AND path <> ''")
    counts = own.groupBy("schema_path").agg(F.count_if(F.col("kind") == "node").alias("nodes"), F.array_sort(F.collect_set("name")).alias("attributes"))
    above = F.regexp_extract("schema_path", "^(.*)/[^/]*$", 1)
    return counts.select("schema_path", F.when(above.contains("/"), above).alias("parent_schema"), "nodes", "attributes")


def write_tables(flat: DataFrame, key: str, folder: str) -> None:
    """Write one folder per schema path for nodes and for their attributes, and one table of marks.

    The folder is named by :func:`table_name`; ``tables`` is the catalog that maps schema paths to them.
    """
    nodes = flat.where("kind = 'node'").select(key, "path", F.nullif("parent_path", F.lit("")).alias("parent_path"), "pos", "type", F.col("value").alias("text"), table_name(F.col("schema_path")).alias("table"))
    nodes.write.mode("overwrite").partitionBy("table").parquet(f"{folder}/nodes")
    attributes = flat.where("kind = 'attr'").select(key, F.col("path").alias("node_path"), "name", "value", table_name(F.col("schema_path")).alias("table"))
    attributes.write.mode("overwrite").partitionBy("table").parquet(f"{folder}/attributes")
    mark_table(flat, key).write.mode("overwrite").parquet(f"{folder}/marks")
    table_catalog(flat).withColumn("table", table_name(F.col("schema_path"))).write.mode("overwrite").parquet(f"{folder}/tables")


def page_trees(api_pages: DataFrame, kinds: frozenset[str] = KINDS) -> DataFrame:
    """Flat rows of the current document of each page: the row with the highest version number.

    Rows are chosen by their place alone, so bodies are neither aggregated nor sorted; they meet the chosen places in
    one join, since their flat rows would be several times as large.
    """
    rows = api_pages.select("page_id", F.col("version.number").alias("number"), "adf", *LOCATOR).where("page_id IS NOT NULL")
    return flat_rows(current_rows(rows, ["page_id"], [F.col("number")]), "page_id", F.col("adf"), kinds)
