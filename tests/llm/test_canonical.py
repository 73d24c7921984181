"""Texts that read the same."""

import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from wikiloom.llm.canonical import canonical_text, look_alike_classes, look_alike_pairs, script_set, with_canonical

SAME = [
    ("Hello", "Ｈｅｌｌｏ"), ("a b", "a b"), ("a b", "a b"), ("café", "café"), ("word", "wo​rd"), ("word", "wo­rd"), ("cat", "сat"),
    ("co-op", "co‑op"), ("office", "oﬃce"), ("カー", "ｶｰ"), ("ガ", "ｶﾞ"), ("ACE 12", "АСЕ 12"), ("привет", "привeт"),
    ("paypal", "ρaypal"), ("apple", "αpple"), ("Apple", "Ꭺpple"), ("HALT", "\u13bb\u13aa\u13de\u0422"), ("bold", "𝐛𝐨𝐥𝐝"), ("γαια", "γaιa"), ("ᎪᏣ", "AᏣ"),
    ("сор вода", "cop вoдa"), ("κόσμος", "κόσμoς"), ("noël", "noёl"), ("100%", "１００％"),
]
OTHER = [("cat", "Cat"), ("cafe", "café"), ("a b", "a\nb"), ("10", "1O"), ("\"x\"", "“x”"), ("x2", "x²"), ("a,b", "a.b"), ("rn", "m"), ("1l", "11"), ("a-b", "a–b")]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert canonical_text(a) == canonical_text(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_other(a, b):
    assert canonical_text(a) != canonical_text(b)


def test_consistent_script():
    assert canonical_text("cаt") == "cat" and canonical_text("вodа") != "voda"
    assert canonical_text("воdа") == canonical_text("вoԁa")
    assert canonical_text("водa") == "вода"
    assert "Latin" in script_set("a") and "Cyrillic" in script_set("a") and script_set("ж") == {"Cyrillic"}


def test_emoji_sequences_stay():
    family = "\U0001f468‍\U0001f469"
    assert canonical_text(family) == family and canonical_text(None) is None and canonical_text("") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abceoxyABC асеожиοαλ́​ Ａé\n1"), max_size=25))
def test_idempotent_and_blind_to_normal_form(text):
    form = canonical_text(text)
    assert canonical_text(form) == form
    assert canonical_text(unicodedata.normalize("NFD", text)) == canonical_text(unicodedata.normalize("NFC", text))


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id bigint, text string, form string, exact string")
    return sorted(tuple(r) for r in look_alike_pairs(df).collect())


def test_pairs(spark):
    rows = [(5, "cat"), (1, "сat"), (2, "cat"), (3, "cаt"), (4, "dog"), (6, "dog"), (7, None), (8, ""), (9, ""), (2, "cat"), (None, "cаt"), (10, "​")]
    assert pairs(spark, rows) == [(1, 2), (1, 3), (1, 5), (2, 3), (3, 5), (8, 10), (9, 10)]
    assert pairs(spark, []) == []


def test_hot_group_of_copies(spark):
    rows = [(i, "the same text") for i in range(3000)] + [(3000, "the same text")]
    assert pairs(spark, rows) == [(i, 3000) for i in range(3000)]


def test_long_text_and_column(spark):
    long = "сat " * 200_000
    df = with_canonical(spark.createDataFrame([(1, long), (2, None)], "id int, text string"), __import__("pyspark.sql.functions", fromlist=["col"]).col("text"))
    got = {r.id: r.canonical for r in df.collect()}
    assert got == {1: "cat " * 200_000, 2: None}


def test_classes_hold_what_pairs_do(spark):
    rows = [(5, "cat"), (1, "\u0441at"), (2, "cat"), (3, "c\u0430t"), (4, "dog"), (6, "dog"), (7, None), (8, ""), (9, ""), (2, "cat"), (None, "c\u0430t"), (10, "\u200b")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, form string, class_id int")
    got = {tuple(r) for r in look_alike_classes(df).collect()}
    assert got == {(5, 1, 2), (1, 1, 1), (2, 1, 2), (3, 1, 3), (8, 8, 8), (9, 8, 8), (10, 8, 10)}
    assert look_alike_classes(df.limit(0)).count() == 0
