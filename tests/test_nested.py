"""Flat tables of nested documents."""

import json

from pyspark.sql import functions as F

from wikiloom.operators import nested

ADF = json.dumps(
    {
        "type": "doc",
        "attrs": {"v": 1},
        "content": [
            {"type": "paragraph", "attrs": {"align": "left", "deep": {"a": [1]}}, "content": [{"type": "text", "text": "x", "marks": [{"type": "em"}, None, {"attrs": {"k": 1}}]}, None, "s", {"Content": [{"TYPE": "rule"}]}]},
            {"type": None, "content": {}, "marks": "no"},
        ],
    }
)


def flat(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id bigint, doc string, kind string, path string")
    return nested.flat_rows(df, "id", F.col("doc"))


def test_nodes_marks_and_attributes(spark):
    rows = flat(spark, [(1, ADF)])
    items = {(r.path, r.type) for r in rows.where("kind <> 'attr'").collect()}
    assert items == {("0", "paragraph"), ("0.0", "text"), ("0.0#0", "em"), ("0.0#2", ""), ("0.3", ""), ("0.3.0", "rule"), ("1", "")}
    nodes = {r.path: (r.parent_path, r.pos, r.schema_path, r.text) for r in nested.node_table(rows, "id").collect()}
    assert nodes["0.3.0"] == ("0.3", 0, "doc/paragraph//rule", None) and nodes["0"][0] is None and nodes["0.0"][3] == "x"
    attrs = {(r.node_path, r.name, r.value) for r in nested.attribute_table(rows, "id").collect()}
    assert attrs == {("", "v", "1"), ("0", "align", "left"), ("0", "deep", '{"a": [1]}')}
    assert {(r.node_path, r.pos, r.type) for r in nested.mark_table(rows, "id").collect()} == {("0.0", 0, "em"), ("0.0", 2, "")}


def test_every_parent_is_there(spark):
    nodes = nested.node_table(flat(spark, [(1, ADF)]), "id")
    orphans = nodes.where("parent_path IS NOT NULL").join(nodes.select("id", F.col("path").alias("parent_path")), ["id", "parent_path"], "left_anti")
    assert orphans.count() == 0


def test_what_is_no_document_gives_no_rows(spark):
    bad = [None, "", " ", "{", "[]", "5", '"text"', "null", ADF[:-5], '{"content": NaN}', '{"content": "x"}']
    assert flat(spark, [(i, t) for i, t in enumerate(bad)]).where("kind <> 'attr'").count() == 0
    assert flat(spark, []).count() == 0


def test_wrapped_keys_repeats_and_null_keys(spark):
    doc = '{"CONTENT": [{"Type": "a", "type": "b"}]}'
    rows = flat(spark, [(1, json.dumps(doc)), (1, json.dumps(doc)), (None, "﻿ " + doc)]).collect()
    assert [(r.id, r.path, r.type) for r in rows] == [(1, "0", "b"), (1, "0", "b"), (None, "0", "b")]


def test_only_one_string_around_a_document_counts(spark):
    doc = '{"content": [{"type": "a"}]}'
    assert flat(spark, [(1, json.dumps(json.dumps(doc)))]).count() == 0


def test_tables_by_schema_path(spark, tmp_path):
    rows = flat(spark, [(1, ADF), (2, ADF)])
    tables = {r.schema_path: r for r in nested.table_catalog(rows).collect()}
    assert {k: (r.parent_schema, r.nodes, r.attributes) for k, r in tables.items() if k.endswith(("paragraph", "text"))} == {
        "doc/paragraph": (None, 2, ["align", "deep"]),
        "doc/paragraph/text": ("doc/paragraph", 2, []),
    }
    nested.write_tables(rows, "id", f"file://{tmp_path}")
    names = {r.schema_path: r.table for r in spark.read.parquet(f"file://{tmp_path}/tables").collect()}
    assert set(names) == set(tables) and {p.name for p in (tmp_path / "nodes").iterdir() if p.is_dir()} == {f"table={n}" for n in names.values()}
    texts = spark.read.parquet(f"file://{tmp_path}/nodes/table={names['doc/paragraph/text']}").collect()
    assert {(r.id, r.path, r.parent_path, r.text) for r in texts} == {(1, "0.0", "0", "x"), (2, "0.0", "0", "x")}
    assert spark.read.parquet(f"file://{tmp_path}/attributes").where(f"table = '{names['doc/paragraph']}'").count() == 4


def test_deep_and_wide_documents(spark):
    depth = 20_000
    deep = '{"content":[' * depth + "{}" + "]}" * depth
    assert nested.parse_document(deep) is not None and nested.parse_document(deep[:-1]) is None
    wide = json.dumps({"content": [{"type": "t"}] * 30_000})
    assert flat(spark, [(1, wide)]).count() == 30_000


def test_deep_parser_agrees():
    for text in (ADF, '{"a": {}, "content": [], "b": [1, "x", {"c": null}]}', ' [ 1 , 2 ] ', '{"a" 1}', '{"a": 1,}', "[1,]", "{1: 2}", '{"a": 1} x', ""):
        try:
            want = json.loads(text, object_pairs_hook=nested.fold_keys)
        except ValueError:
            want = None
        assert nested.parse_deep(text) == want
