"""Leaks against a check of every alignment."""

import random

import pytest

from wikiloom.llm.leakage import Index, judge, leaks, matches, tiles, words


def brute(doc, item, window=13):
    return any(
        sum(doc[i + k] == item[j + k] for k in range(window)) >= window - 1 for i in range(len(doc) - window + 1) for j in range(len(item) - window + 1)
    )


@pytest.mark.parametrize("seed", range(8))
def test_every_window_is_found(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(10, 40))] for _ in range(30)]
    index = Index([(n, " ".join(x)) for n, x in enumerate(items)], 6)
    for _ in range(60):
        doc = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        item = rng.choice(items)
        a = rng.randrange(len(item))
        part = item[a : a + rng.randint(5, 20)]
        for _ in range(rng.choice([0, 1, 1, 2])):
            part[rng.randrange(len(part))] = "other"
        at = rng.randint(0, len(doc))
        doc[at:at] = part
        numbers = index.numbers(doc)
        found = matches(numbers, index)
        got = {n for n, m in found.items() if judge(numbers, index.rows[n], m, 6, 13)[0]}
        assert got == {n for n, x in enumerate(items) if brute(doc, x)}


def test_tiles_are_greedy_and_do_not_overlap():
    assert tiles([(0, 0, 20), (10, 30, 15)], 6) == [(0, 0, 20)]
    assert tiles([(0, 0, 20), (12, 30, 15)], 6) == [(0, 0, 20), (20, 38, 7)]
    assert sorted(tiles([(0, 20, 10), (10, 0, 10)], 6)) == [(0, 20, 10), (10, 0, 10)]


def slow_tiles(doc, item, least):
    """The definition: again and again the longest run of unmarked equal words, the first one of equals."""
    marked_doc, marked_item, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in marked_doc and j + n not in marked_item:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        out.append((i, j, n))
        marked_doc.update(range(i, i + n))
        marked_item.update(range(j, j + n))


@pytest.mark.parametrize("seed", range(6))
def test_tiles_agree_with_the_definition(seed):
    rng = random.Random(seed)
    for _ in range(25):
        vocab = [f"w{i}" for i in range(rng.choice([2, 3, 6, 40]))]
        item = [rng.choice(vocab) for _ in range(rng.randint(6, 40))]
        doc = [rng.choice(vocab) for _ in range(9)]
        for _ in range(3):
            a = rng.randrange(len(item))
            doc += item[a : a + rng.randint(1, 15)]
        index = Index([(0, " ".join(item))], 6)
        numbers = index.numbers(doc)
        found = matches(numbers, index).get(0, [])
        own = tiles(found, 6) if found else []
        assert sum(t[2] for t in own) == sum(t[2] for t in slow_tiles(doc, item, 6))
        exact = bool(found) and judge(numbers, index.rows[0], found, 6, 13)[0]
        assert exact == (len(item) >= 13 and brute(doc, item))


def test_words():
    assert words("**Bold** <b>wo</b>rd, [link text](http://x/y) &amp; x​y ＡＢＣ сat CAFÉ") == ["bold", "word", "link", "text", "xy", "abc", "cat", "café"]
    assert words(None) == words("") == []


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id bigint, text string, item_id string, tiles int")
    e = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id int, text string, doc_id string")
    return leaks(d, e, **kw)


def test_table(spark):
    docs = [(1, PASSAGE.upper()), (2, PASSAGE.replace("seven", "x")), (3, PASSAGE.replace("three", "x").replace("ten", "y")), (4, None), (5, ""), (6, "a " * 100_000 + PASSAGE), (6, PASSAGE), (7, "nothing here")]
    for extra in ({}, {"block_chars": 40}, {"least": 2.0}):
        got = run(spark, docs, [(9, PASSAGE), (10, "too short for the window of words"), (11, None), (12, "")], **extra).collect()
        assert {r.doc_id for r in got if r.exact} == {1, 2, 6} and all(r.item_id == 9 for r in got)
        assert next(r for r in got if r.doc_id == 1).coverage == 1.0


def test_reordered_passage_has_coverage(spark):
    half = PASSAGE.split()
    (r,) = run(spark, [(1, " ".join(half[7:] + ["then"] + half[:7]))], [(9, PASSAGE)]).collect()
    assert not r.exact and r.tiles == 2 and r.coverage == 1.0


def test_empty(spark):
    assert run(spark, [], [(1, PASSAGE)]).count() == 0 and run(spark, [(1, PASSAGE)], []).count() == 0
