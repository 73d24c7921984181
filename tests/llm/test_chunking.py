"""Pieces of oversized texts."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from wikiloom.llm.chunking import pieces, split_text


def check(text, limit, overlap):
    cuts = split_text(text, limit, overlap)
    assert "".join(text[a:b] for _, a, b, _ in cuts) == text
    assert all(b - o <= limit for o, _, b, _ in cuts)
    assert all(0 <= a - o <= overlap for o, a, _, _ in cuts) and cuts[0][0] == 0
    for n, (o, a, _, forced) in enumerate(cuts):
        if n:
            assert o >= cuts[n - 1][0]
        if n and not forced:
            assert text[a - 1].isspace() or text[a].isspace() or text[a - 1] in "。！？"
    run = max(map(len, text.split()), default=0)
    if run > limit:
        assert any(c[3] for c in cuts)
    elif not any(c in text for c in "。！？"):
        assert not any(c[3] for c in cuts)
    return cuts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 80), st.sampled_from([" ", "\n", "\n\n", "  ", ". ", "\t"])), max_size=60), st.integers(10, 60), st.integers(0, 4))
def test_any_text(words, limit, overlap):
    check("".join("x" * n + sep for n, sep in words), limit, overlap)


def test_short_text_is_one_piece():
    assert split_text("", 10, 2) == [(0, 0, 0, False)] and split_text("a" * 10, 10, 2) == [(0, 0, 10, False)]


def test_cut_at_the_strongest_boundary_near_the_middle():
    text = "a b c. " * 10 + "\n\n" + "d e f. " * 10
    cuts = split_text(text, 100, 0)
    assert cuts[1][1] == text.index("d")


def test_run_over_the_limit_is_cut_by_force_and_one_just_under_is_not():
    assert any(c[3] for c in check("ab " + "x" * 101 + " cd", 100, 10))
    cuts = check("ab " + "x" * 99 + " " + "cd " * 40, 100, 10)
    assert not any(c[3] for c in cuts)


def test_combining_characters_stay_with_their_base():
    text = "é" * 200
    assert all(text[a] == "e" for _, a, _, _ in split_text(text, 100, 0))


def test_long_text_with_overlap():
    rng = random.Random(1)
    text = " ".join("w" * rng.randint(1, 12) for _ in range(200_000))
    cuts = check(text, 3000, 200)
    assert sum(a - o for o, a, _, _ in cuts[1:]) > 150 * (len(cuts) - 1)


def test_table(spark):
    rows = [(1, None, "c", 0), (2, "", "c", 0), (3, "x " * 3000, "c", 0), (3, "x " * 3000, "c", 0), (None, "y", "c", 0)]
    df = spark.createDataFrame(rows, "id int, body string, text string, piece int")
    found = pieces(df, "id", "body").collect()
    assert {(r.id, r.piece, r.text) for r in found if r.id != 3} == {(2, 0, ""), (None, 0, "y")}
    threes = [r for r in found if r.id == 3]
    assert len(threes) % 2 == 0 and all(len(r.text) <= 3000 and not r.forced for r in threes)
    assert pieces(df.limit(0), "id", "body").count() == 0
    with pytest.raises(ValueError):
        pieces(df, "id", "body", 10, 9)
