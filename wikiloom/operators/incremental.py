"""Processing only new or changed records.

Deliveries carry the transaction (a run of the crawler) that wrote them. With each success the oldest transaction is
remembered that was still open then; the next run rereads from there, so what such a transaction commits late is not
skipped. What is read twice is removed by an anti-join of (key, version, state) against the pairs that were read before,
and what is left is new or changed only if the ledger's last entry of its key does not settle it.

A run goes through three states, each entered by one rename: nothing, ``pending`` (its records are fixed, so every further
attempt works on the same ones) and ``run`` (done, together with the output of the work). A run that is done is never worked
on again, and one that is not has left nothing that counts.

The ledger keeps a row per key and run in which it was processed. Every few runs the last entries of all keys are merged
into a ``state``, which costs in proportion to the keys; a run reads the last state and the few runs since.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.functions.text import canonical_signature, strip_white, to_id
from wikiloom.operators.snapshots import latest_rows
from wikiloom.session import materialize

LEDGER = ("key", "version", "state", "run_id")


def successful_runs(run_state: DataFrame) -> list[int]:
    """Numbers of the runs that succeeded, ascending. One number per run of the crawler reaches the driver."""
    done = run_state.where(F.col("last_successful.started") == F.col("crawl_started_at")).select("run_id").distinct()
    return sorted(r[0] for r in done.collect() if r[0] is not None)


def candidates(feed: DataFrame) -> DataFrame:
    """(key, version, state): per key the delivery of the highest version, then the latest."""
    return latest_rows(feed, ["key"], [F.col("version"), F.col("received_at")], ["version", "state"])


def between(feed: DataFrame, low: int | None, upto: int) -> DataFrame:
    """Deliveries of the transactions from ``low`` on; the bounds reach the scan."""
    span = F.col("run_id") <= upto
    return feed.where(span if low is None else span & (F.col("run_id") >= low))


def unread(rows: DataFrame, read: DataFrame) -> DataFrame:
    """Rows whose (key, version, state) was not read before."""
    pairs = read.select(F.col("key").alias("k"), F.col("version").alias("v"), F.col("state").alias("s"))
    same = (F.col("k") == F.col("key")) & F.col("v").eqNullSafe(F.col("version")) & F.col("s").eqNullSafe(F.col("state"))
    return rows.join(pairs, same, "left_anti")


def new_or_changed(found: DataFrame, current: DataFrame) -> DataFrame:
    """Candidates that are not settled by the last entry of their key, of which ``current`` has one per key.

    An entry settles a candidate of a lower version, or of the same version and state. NULL versions are the lowest.
    """
    last = current.select(F.col("key").alias("k"), F.col("version").alias("v"), F.col("state").alias("s"))
    floor = F.lit(-(2**63)).cast("bigint")
    was, now = F.coalesce("v", floor), F.coalesce("version", floor)
    settled = (F.col("k") == F.col("key")) & ((was > now) | ((was == now) & F.col("s").eqNullSafe(F.col("state"))))
    return found.join(last, settled, "left_anti")


def process_run(feed: DataFrame, current: DataFrame | None, run_id: int, low: int | None = None, closed: int | None = None, read: DataFrame | None = None) -> DataFrame:
    """Ledger rows of one run: what it has to process of the transactions from ``low``, the oldest one open at the last
    success, up to its own.

    ``closed`` is the last transaction that the last success read up to; of those up to it only pairs that are not in
    ``read`` count. ``current`` has the last entry of each key.
    """
    rows = between(feed, low, run_id)
    if read is not None and closed is not None:
        rows = rows.where(F.col("run_id") > closed).unionByName(unread(rows.where(F.col("run_id") <= closed), read))
    found = candidates(rows)
    fresh = found if current is None else new_or_changed(found, current)
    return fresh.select("key", "version", "state", F.lit(run_id).alias("run_id"))


def last_entries(parts: Sequence[DataFrame]) -> DataFrame | None:
    """One row per key: its entry of the latest run; None without parts."""
    if not parts:
        return None
    ledger = parts[0]
    for p in parts[1:]:
        ledger = ledger.unionByName(p)
    return latest_rows(ledger, ["key"], [F.col("run_id")], ["version", "state", "run_id"])


#: Runs after which the last entries of all keys are merged into one state.
MERGE_EVERY = 8


def replay(feed: DataFrame, runs: Sequence[int]) -> DataFrame:
    """Ledger of all successful runs in turn: (key, version, state, run_id).

    A success closes every run up to its own, so the oldest open one is the next. Each run's rows are written to the
    shared checkpoint folder before the next run reads them, as in production. Rows without a key or run are left out;
    repeated deliveries count once; an empty feed or no runs give no rows.
    """
    ledger: DataFrame | None = None
    parts: list[DataFrame] = []
    low: int | None = None
    for run_id in runs:
        fresh = materialize(process_run(feed, last_entries(parts), run_id, low))
        ledger = fresh if ledger is None else ledger.unionByName(fresh)
        parts.append(fresh)
        if len(parts) > MERGE_EVERY:
            parts = [materialize(last_entries(parts))]
        low = run_id + 1
    if ledger is None:
        return feed.select("key", F.col("version").cast("bigint"), "state", F.col("run_id").cast("int")).limit(0)
    return ledger


def feed_of_pages(page_feed: DataFrame) -> DataFrame:
    """``page_feed`` in the form that :func:`replay` takes: the state is version, stripped title and ordered signature."""
    state = F.struct(strip_white("title").alias("title"), canonical_signature("attachment_signature").alias("signature"))
    return page_feed.select(
        "run_id", to_id("id").alias("key"), F.col("version").cast("bigint").alias("version"), state.alias("state"), "received_at"
    ).where(F.col("key").isNotNull() & F.col("run_id").isNotNull())


@dataclass(frozen=True)
class Entry:
    """A folder of the ledger: a ``run``, a ``pending`` run, or a ``state``; and the oldest transaction open at it."""

    kind: str
    run_id: int
    oldest_open: int
    name: str


class Folder:
    """A ledger folder, through the file system of the session (driver side; only names are looked at)."""

    NAME = re.compile(r"(run|pending|state)=(\d+),open=(\d+)")

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.jvm_path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def entries(self) -> list[Entry]:
        """What is there, in one listing."""
        at = self.jvm_path(self.path)
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        found = [(m, n) for n in names if (m := self.NAME.fullmatch(n))]
        return sorted((Entry(m[1], int(m[2]), int(m[3]), n) for m, n in found), key=lambda e: e.run_id)

    def put(self, write: Callable[[str], None], kind: str, run_id: int, oldest_open: int) -> Entry:
        """Let ``write`` fill a folder of this attempt, and give it its name."""
        attempt = f"attempt-{uuid.uuid4().hex}"
        write(f"{self.path}/{attempt}")
        return self.rename(attempt, Entry(kind, run_id, oldest_open, f"{kind}={run_id},open={oldest_open}"))

    def rename(self, old: str, entry: Entry) -> Entry:
        if not self.fs.rename(self.jvm_path(f"{self.path}/{old}"), self.jvm_path(f"{self.path}/{entry.name}")):
            raise RuntimeError(f"{old} of {self.path} could not become {entry.name}")
        return entry

    def read(self, entry: Entry, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{entry.name}/{part}")


def current_entries(folder: Folder, entries: Sequence[Entry], before: int) -> tuple[DataFrame | None, int]:
    """Last entry of each key over all runs before one, and from how many folders it was put together."""
    states = [e for e in entries if e.kind == "state" and e.run_id < before]
    since = states[-1].run_id if states else -1
    used = states[-1:] + [e for e in entries if e.kind == "run" and since < e.run_id < before]
    return last_entries([folder.read(e, "cases") for e in used]), len(used)


def run_with_ledger(feed: DataFrame, ledger_path: str, run_id: int, work: Callable[[DataFrame], DataFrame | None], oldest_open: int | None = None) -> DataFrame:
    """One production run: find the records, let ``work`` process them, commit; gives the ledger rows of the run.

    ``oldest_open`` is the oldest transaction that is open now; by default none is, up to the run's own. The feed is read
    from the one that the last success remembered. A run that failed at any point is simply started again: once pending,
    it works on the same records, and once done, on none. What ``work`` returns is written as ``output`` of the run and
    becomes visible with it, so it is there exactly once; other effects of ``work`` should be keyed by run.
    """
    folder = Folder(feed.sparkSession, ledger_path)
    entries = folder.entries()
    mine = {e.kind: e for e in entries if e.run_id == run_id and e.kind != "state"}
    if done := mine.get("run"):
        return folder.read(done, "cases")
    pending = mine.get("pending")
    if pending is None:
        last = [e for e in entries if e.kind == "run" and e.run_id < run_id][-1:]
        low, closed = (last[0].oldest_open, last[0].run_id) if last else (None, None)
        read = folder.read(last[0], "read") if last and low <= closed else None
        current, _ = current_entries(folder, entries, run_id)
        keep = run_id + 1 if oldest_open is None else min(oldest_open, run_id + 1)
        # Written once: what arrives while this run works is for the next, and not half read.
        rows = materialize(between(feed, low, run_id))

        def write(path: str) -> None:
            process_run(rows, current, run_id, low, closed, read).write.parquet(f"{path}/cases")
            again = between(rows, keep, run_id)
            again.select("key", "version", "state").distinct().write.parquet(f"{path}/read")

        pending = folder.put(write, "pending", run_id, keep)
    output = work(folder.read(pending, "cases"))
    if output is not None:
        output.write.mode("overwrite").parquet(f"{folder.path}/{pending.name}/output")
    done = folder.rename(pending.name, Entry("run", run_id, pending.oldest_open, f"run={run_id},open={pending.oldest_open}"))
    merged, parts = current_entries(folder, folder.entries(), run_id + 1)
    if parts > MERGE_EVERY:
        folder.put(lambda path: merged.write.parquet(f"{path}/cases"), "state", run_id, pending.oldest_open)
    return folder.read(done, "cases")


def classify_pages(state: DataFrame, previous: DataFrame, with_attachments: bool = True) -> DataFrame:
    """deleted, dirty or clean for each page of ``state`` against its record in the snapshot before.

    ``state``: page_id, found, status, title, version, signature, error; ``previous``: page_id, title, version, signature.
    A page that was not found, or is trashed, is deleted; one whose state could not be read or has no title, that is
    new, or whose version, title or signature differs is dirty. A blank previous signature counts as different.
    """
    prev = previous.select(
        "page_id", F.lit(True).alias("had"), F.col("title").alias("p_title"), F.col("version").alias("p_version"), F.col("signature").alias("p_signature")
    )
    differs = ~F.col("version").eqNullSafe(F.col("p_version")) | ~F.col("title").eqNullSafe(F.col("p_title"))
    if with_attachments:
        blank = F.coalesce(strip_white("p_signature"), F.lit("")) == ""
        differs = differs | blank | ~F.col("signature").eqNullSafe(F.col("p_signature"))
    kind: Column = (
        F.when(F.col("error").isNotNull(), "dirty")
        .when(~F.coalesce("found", F.lit(False)) | (F.lower(strip_white("status")) == "trashed"), "deleted")
        .when(F.coalesce(strip_white("title"), F.lit("")) == "", "dirty")
        .when(F.col("had").isNull(), "dirty")
        .when(differs, "dirty")
        .otherwise("clean")
    )
    return state.join(prev, "page_id", "left").withColumn("kind", kind)
