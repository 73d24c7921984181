"""Streaming forms: the change feed as micro-batches over the same ledger, and counts per event-time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from wikiloom.functions.text import strip_white, to_id
from wikiloom.operators import incremental


def process_changes(feed: DataFrame, ledger_path: str, work: Callable[[DataFrame], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``work`` on the records that are new or changed, once per micro-batch.

    A batch is a run: its number is the batch id, which Structured Streaming repeats after a failure. A batch that is
    repeated finds its run pending, and works on the same records, or done, and works on none. ``feed`` is a stream of page
    states.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        states = incremental.feed_of_pages(rows.withColumn("run_id", F.lit(batch_id)))
        incremental.run_with_ledger(states, ledger_path, batch_id, work)

    writer = feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def edits_per_window(feed: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Deliveries and pages per window of arrival; rows later than ``late`` are dropped, repeats of a state count once."""
    rows = feed.select("received_at", to_id("id").alias("page_id"), "version", strip_white("title").alias("title"))
    once = rows.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["page_id", "version", "title"])
    return once.groupBy(F.window("received_at", width)).agg(F.count("*").alias("deliveries"), F.approx_count_distinct("page_id").alias("pages"))
