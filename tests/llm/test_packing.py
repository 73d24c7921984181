"""Containers."""

import math
import random
from collections import defaultdict

import pytest

from wikiloom.llm.packing import TOKENIZER, attention, pack, plan_containers, token_counts, with_capacities


def fill(placements):
    used = defaultdict(list)
    for size, _, n, first in placements:
        for b in range(first, first + n):
            used[b].append(size)
    return used


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_near_the_bound(seed):
    rng = random.Random(seed)
    counts = defaultdict(int)
    for _ in range(3000):
        counts[min(100, int(rng.expovariate(1 / 30)) + 1)] += 1
    placements, containers = plan_containers(dict(counts), [25, 50, 100])
    used = fill(placements)
    placed = defaultdict(int)
    for sizes in used.values():
        assert sum(sizes) <= 100
        for s in sizes:
            placed[s] += 1
    assert placed == counts
    assert len(used) == sum(n for _, n, _, _ in containers) and sorted(used) == list(range(len(used)))
    for first, n, held, cap in containers:
        assert held <= cap and all(sum(used[b]) == held for b in range(first, first + n))
    bound = math.ceil(sum(s * n for s, n in counts.items()) / 100)
    assert len(used) <= bound * 1.01 + 2


def test_plan_of_a_huge_count_is_small():
    placements, containers = plan_containers({700: 10**12, 300: 10**12, 5: 3}, [1000])
    assert len(placements) < 20 and sum(n for _, n, _, _ in containers) == 10**12 + 1


def paid(containers, cost):
    return sum(n * cost(cap) for _, n, _, cap in containers)


def test_cost_decides_what_is_opened():

    def plan(*args, **named):
        out = defaultdict(int)
        for _, n, _, cap in plan_containers(*args, **named)[1]:
            out[cap] += n
        return set(out.items())

    assert plan({20: 4}, [25, 100], cost=lambda c: c) == {(25, 4)}  # four small ones hold the same as one large one
    assert plan({20: 4}, [25, 100], cost=lambda c: c + 50) == {(100, 1)}  # a fixed part for each container
    assert plan({20: 5}, [25, 100]) == {(100, 1)} and plan({10: 1}, [25, 100]) == {(25, 1)}
    # What is left at the end fits a smaller size: the estimate is made of what is still to be placed.
    assert plan({60: 3}, [60, 120]) == {(120, 1), (60, 1)}


def test_several_lengths_cost_less_than_one():
    rng = random.Random(3)
    counts = defaultdict(int)
    for _ in range(4000):
        counts[min(2048, int(rng.lognormvariate(5, 1)) + 1)] += 1
    _, joint = plan_containers(dict(counts), [256, 512, 1024, 2048], attention)
    _, plain = plan_containers(dict(counts), [2048], attention)
    assert len({c[3] for c in joint}) > 1 and paid(joint, attention) < 0.95 * paid(plain, attention)


def test_placements_know_the_final_capacity():
    placements, containers = plan_containers({60: 7, 30: 3, 5: 2}, [40, 70, 100])
    caps = {b: cap for first, n, _, cap in containers for b in range(first, first + n)}
    rows = with_capacities(placements, containers)
    assert sum(r[2] for r in rows) == 12 and all(caps[b] == r[4] for r in rows for b in range(r[3], r[3] + r[2]))


def test_pack(spark):
    rows = [(i, s, "c", 0) for i, s in enumerate([100, 99, 60, 40, 41, 1, 0, None, 250, 60])]
    df = spark.createDataFrame(rows, "doc_id int, tokens int, container string, part int")
    got = pack(df, "doc_id", 100, (50, 100), per_group=3).collect()
    by = defaultdict(int)
    parts = defaultdict(list)
    for r in got:
        if r.container is None:
            assert r.tokens == 0 and r.doc_id in (6, 7) and r.container_capacity is None
        else:
            by[r.container] += r.tokens
            assert r.container_capacity in (50, 100)
        parts[r.doc_id].append((r.part, r.first_token, r.tokens))
    assert max(by.values()) <= 100 and len(by) == 7
    assert sorted(parts[8]) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert all(len(v) == 1 for k, v in parts.items() if k != 8) and len(parts) == 10


def test_hot_size_and_empty(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "7 AS tokens")
    got = pack(df, "doc_id", 100, (100,), per_group=100).groupBy("container").sum("tokens").collect()
    assert len(got) == math.ceil(5000 / 14) and max(r[1] for r in got) <= 100
    assert pack(df.limit(0), "doc_id", 100).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "<|endoftext|>"), (5, "a" * 50_000)], "doc_id int, text string")
    got = {r.doc_id: r.tokens for r in token_counts(df, "doc_id", "text", TOKENIZER).collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 1 and got[5] > 1000


def test_both_libraries_count_alike():
    from wikiloom.llm.packing import token_counter

    texts = ["It's  a test, x_1 = 2!\n\n日本語 café \U0001f680", "", " ", "\t\ta"]
    assert token_counter(TOKENIZER)(texts) == token_counter(TOKENIZER.replace(".tiktoken", ".json"))(texts)
