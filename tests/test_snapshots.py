"""Snapshot differences and increments against plain loops over the definitions."""

import random
from datetime import datetime, timedelta

import pytest

from wikiloom.operators import incremental, snapshots

T0 = datetime(2025, 1, 1)
RECORDS = "run_id int, id string, title string, version int, attachment_signature string, crawled_at timestamp, fetch_error string, ord int, _key string, value string"


def rec(run, id_, title="t", version=1, sig=None, at=0, error=None):
    return (run, id_, title, version, sig, T0 + timedelta(minutes=at), error, 9, "clash", "clash")


def changes(spark, rows):
    found = snapshots.page_changes(spark.createDataFrame(rows, RECORDS))
    return {(r.run_id, r.page_id): (r.change_type, r.changed_fields) for r in found.collect()}


def test_kinds_of_change(spark):
    rows = [
        rec(1, " 1 "), rec(1, "2", version=4), rec(1, "3", sig="b;a"), rec(1, "4", sig=" "), rec(1, "5"), rec(1, "6", error="x"),
        rec(3, "1", title="t \t"), rec(3, "2", version=5, title="u"), rec(3, "3", sig="a;b"), rec(3, "4", sig=None), rec(3, "7"), rec(3, "6", error=" "),
    ]
    assert changes(spark, rows) == {(3, 2): ("changed", ["title", "version"]), (3, 5): ("removed", None), (3, 7): ("added", None), (3, 6): ("added", None)}


def test_failures_keep_the_state_of_the_snapshot_before(spark):
    rows = [rec(1, "1", version=1), rec(2, "1", version=9, error="503"), rec(3, "1", version=1), rec(1, "2"), rec(3, "2", error="503"), rec(2, "3", error="e"), rec(3, "3", error="e"), rec(2, "9"), rec(3, "9")]
    assert changes(spark, rows) == {(2, 9): ("added", None), (2, 2): ("removed", None)}


def test_latest_row_counts_and_repeats_do_not(spark):
    rows = [rec(1, "1"), rec(2, "1", version=7, at=1), rec(2, "1", version=1, at=5), rec(2, "1", version=1, at=5)]
    assert changes(spark, rows) == {}


def test_nulls_and_empty_tables(spark):
    assert changes(spark, []) == {}
    assert changes(spark, [rec(1, "1")]) == {}
    rows = [rec(1, None), rec(None, "1"), rec(1, "x1"), rec(1, "1", None, None, None), rec(2, "1", None, None, None), rec(2, "2", "x" * 100_000)]
    assert changes(spark, rows) == {(2, 2): ("added", None)}


def test_random_histories(spark):
    rng = random.Random(5)
    rows, runs = [], [1, 2, 4, 7]
    for run in runs:
        for p in range(40):
            if rng.random() < 0.8:
                rows.append(rec(run, str(p), rng.choice("ab"), rng.randint(1, 2), rng.choice([None, "", "x"]), 0, rng.choice([None, None, None, "err"])))
    before = {}
    expected = {}
    for n, run in enumerate(runs):
        now = {}
        for r in rows:
            if r[0] == run:
                state = (r[3], r[2], r[4] or "")
                if r[6] is None:
                    now[int(r[1])] = state
                elif int(r[1]) in before:
                    now[int(r[1])] = before[int(r[1])]
        for p in (set(now) | set(before)) if n else ():
            if now.get(p) != before.get(p):
                expected[(run, p)] = "added" if p not in before else "removed" if p not in now else "changed"
        before = now
    assert {k: v[0] for k, v in changes(spark, rows).items()} == expected


FEED = "run_id int, id string, version int, title string, attachment_signature string, received_at timestamp, key string, state string, ledger int"


def replayed(spark, rows, runs):
    df = spark.createDataFrame([(*r[:4], r[4], T0 + timedelta(minutes=r[5]), "k", "s", 1) for r in rows], FEED)
    return sorted((r.run_id, r.key) for r in incremental.replay(incremental.feed_of_pages(df), runs).collect())


def test_failed_runs_are_read_again_and_nothing_twice(spark):
    rows = [(1, "1", 1, "t", None, 0), (2, "2", 1, "t", None, 1), (3, "1 ", 1, "t ", "", 2), (3, "2", 1, "t", None, 3), (4, "1", 2, "t", None, 4), (5, "1", 1, "t", None, 5), (6, "1", 2, "u", None, 6), (7, "9", 1, "t", None, 7)]
    assert replayed(spark, rows, [1, 3, 4, 5, 6]) == [(1, 1), (3, 2), (4, 1), (6, 1)]


def test_back_and_forth_is_two_changes(spark):
    rows = [(1, "1", 2, "a", None, 0), (2, "1", 2, "b", None, 1), (3, "1", 2, "a", None, 2), (4, "1", 2, "a", None, 3)]
    assert replayed(spark, rows, [1, 2, 3, 4]) == [(1, 1), (2, 1), (3, 1)]


def test_random_feeds(spark):
    rng = random.Random(8)
    runs = [2, 3, 5]
    rows = [(rng.randint(1, 6), str(rng.randint(1, 9)), rng.randint(1, 3), rng.choice("ab"), rng.choice([None, " ", "x;y", "y;x"]), i) for i in range(120)]
    last, out, prev = {}, [], 0
    for run in runs:
        best = {}
        for r in rows:
            if prev < r[0] <= run:
                own = (r[2], r[5], (r[3], ";".join(sorted((r[4] or "").strip().split(";")))))
                best[r[1]] = max(best.get(r[1], own), own)
        for p, (v, _, s) in best.items():
            if p not in last or v > last[p][0] or (v == last[p][0] and s != last[p][1]):
                last[p] = (v, s)
                out.append((run, int(p)))
        prev = run
    assert replayed(spark, rows, runs) == sorted(out)


def test_feed_nulls_and_empty(spark):
    assert replayed(spark, [], [1]) == [] and replayed(spark, [(1, "1", 1, "t", None, 0)], []) == []
    rows = [(1, None, 1, "t", None, 0), (1, "1", None, None, None, 0), (2, "1", None, None, None, 1), (3, "1", 0, None, None, 2)]
    assert replayed(spark, rows, [1, 2, 3]) == [(1, 1), (3, 1)]


def feed_rows(spark, *rows):
    """Deliveries (transaction, page, version, title, minute)."""
    return incremental.feed_of_pages(spark.createDataFrame([(r, p, v, t, None, T0 + timedelta(minutes=m), "k", "s", 1) for r, p, v, t, m in rows], FEED))


def keys(df):
    return sorted(r.key for r in df.collect())


def test_a_run_survives_a_failure_at_every_step(spark, tmp_path, monkeypatch):
    feed = feed_rows(spark, (1, "1", 1, "t", 0), (2, "1", 1, "t", 0), (2, "2", 1, "t", 0))
    more = feed.unionByName(feed_rows(spark, (2, "3", 1, "t", 1)))
    path, seen = f"file://{tmp_path}/ledger", []

    def work(df):
        seen.append(keys(df))
        return df.select("key")

    assert keys(incremental.run_with_ledger(feed, path, 1, work)) == [1]
    with monkeypatch.context() as m:  # before anything is fixed
        m.setattr(incremental.Folder, "put", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            incremental.run_with_ledger(feed, path, 2, work)
    assert seen == [[1]]
    with pytest.raises(RuntimeError):  # within the work

        def fail(df):
            raise RuntimeError("lost")

        incremental.run_with_ledger(feed, path, 2, fail)
    with monkeypatch.context() as m:  # after the work, before the run is done
        m.setattr(incremental.Folder, "rename", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            incremental.run_with_ledger(more, path, 2, work)
    assert not list(tmp_path.glob("ledger/run=2*")) and seen == [[1], [2]]
    assert keys(incremental.run_with_ledger(more, path, 2, work)) == [2] and seen == [[1], [2], [2]]
    assert keys(incremental.run_with_ledger(more, path, 2, work)) == [2] and len(seen) == 3
    assert keys(spark.read.parquet(f"{path}/run=2,open=3/output")) == [2]
    assert keys(incremental.run_with_ledger(more.unionByName(feed_rows(spark, (3, "3", 2, "t", 2))), path, 3, work)) == [3]


def test_what_an_open_transaction_commits_late_is_not_skipped(spark, tmp_path):
    path, none = f"file://{tmp_path}/ledger", lambda df: None
    early = [(3, "1", 1, "a", 0), (5, "2", 1, "a", 1), (5, "4", 3, "a", 1)]
    assert keys(incremental.run_with_ledger(feed_rows(spark, *early), path, 5, none, oldest_open=3)) == [1, 2, 4]
    late = [(3, "3", 1, "a", 2), (4, "4", 2, "b", 3), (3, "2", 1, "a", 4)]
    assert keys(incremental.run_with_ledger(feed_rows(spark, *early, *late, (6, "5", 1, "a", 5)), path, 6, none)) == [3, 5]
    assert keys(incremental.run_with_ledger(feed_rows(spark, *early, *late, (4, "9", 1, "a", 9), (7, "5", 1, "b", 6)), path, 7, none)) == [5]


def test_merged_states_settle_like_the_runs_they_replace(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MERGE_EVERY", 2)
    path, got = f"file://{tmp_path}/ledger", []
    rows = [(r, str(p), r // 2, "t", r) for r in range(1, 7) for p in range(r, 8)]
    for run in range(1, 7):
        got += [(run, k) for k in keys(incremental.run_with_ledger(feed_rows(spark, *rows), path, run, lambda df: None))]
    assert got == sorted((r.run_id, r.key) for r in incremental.replay(feed_rows(spark, *rows), range(1, 7)).collect())
    assert {e.run_id for e in incremental.Folder(spark, path).entries() if e.kind == "state"} == {3, 5}


def test_classification(spark):
    state = spark.createDataFrame(
        [(1, True, "current", "A", 7, "s", None), (2, True, "Trashed ", "B", 1, "s", None), (3, None, None, None, None, None, None), (4, True, "current", " ", 1, "s", None), (5, True, "current", "N", 1, "s", None),
         (6, True, "current", "A", 7, "s", None), (7, None, None, None, None, None, "503"), (8, True, "current", "A", 8, "s", None)],
        "page_id int, found boolean, status string, title string, version int, signature string, error string",
    )
    prev = spark.createDataFrame([(1, "A", 7, "s"), (2, "B", 1, "s"), (3, "C", 1, "s"), (4, "D", 1, "s"), (6, "A", 7, " "), (7, "G", 1, "s"), (8, "A", 7, "s")], "page_id int, title string, version int, signature string")
    kinds = {r.page_id: r.kind for r in incremental.classify_pages(state, prev).collect()}
    assert kinds == {1: "clean", 2: "deleted", 3: "deleted", 4: "dirty", 5: "dirty", 6: "dirty", 7: "dirty", 8: "dirty"}
    off = {r.page_id: r.kind for r in incremental.classify_pages(state, prev, with_attachments=False).collect()}
    assert off[6] == "clean"


def test_diff_plan_reuses_the_partitioning(spark):
    rows = spark.createDataFrame([rec(1, "1"), rec(2, "1", version=2)], RECORDS)
    plan = snapshots.page_changes(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(_key") <= 3 and "CartesianProduct" not in plan
