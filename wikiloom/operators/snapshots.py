"""What changed between full snapshots.

Snapshots are unpivoted into signed cells (key, field, value): +1 in the later snapshot of a pair, -1 in the earlier
one, with one more cell per key that marks its presence. Cells that are equal in both cancel out in a grouped sum;
what is left classifies the key and names the fields that differ.

Shuffles: one on (key, snapshot) after map-side combination to find the row that counts, and one on the key for
carrying states over failed rows; both grouped sums reuse the latter's partitioning. No text body takes part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wikiloom.functions.text import canonical_signature, strip_white, to_id

PRESENCE = "\x00presence"


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """One row per key: the one that is greatest in ``order``.

    Nulls in ``order`` are the least. Ties are settled by the values themselves, so that the result does not depend
    on the order of rows. Combined map-side, so a key repeated millions of times sends one row per task.
    """
    best = F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*values).alias("v")))
    return df.groupBy(*keys).agg(best.alias("best")).select(*keys, *[F.col(f"best.v.{v}").alias(v) for v in values])


#: Where a row stands: a digest of its file, and its number in it. Unique within a table.
LOCATOR = ("_file", "_row")


def chosen_places(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """(*LOCATOR) of the row of each key that is greatest in ``order``, ties settled by place; no other column is read."""
    best = F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *LOCATOR))
    return rows.groupBy(*keys).agg(best.alias("best")).select(*[F.col(f"best.{c}").alias(c) for c in LOCATOR])


def current_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], found: DataFrame | None = None) -> DataFrame:
    """``found``, or else ``rows``, without all rows that are not the current one of their key.

    ``found`` holds what was extracted from ``rows`` in place, with its LOCATOR: extracting first keeps bodies out of
    every exchange. Only places are aggregated. A row of two numbers per key is hashed partition by partition, so neither
    side is sorted and nothing is broadcast.
    """
    everything = rows if found is None else found
    return everything.join(chosen_places(rows, keys, order).hint("shuffle_hash"), list(LOCATOR), "left_semi").drop(*LOCATOR)


#: Ids up to which a set of them is broadcast: 16 bytes each in memory, thus at most some 32 MB.
BROADCAST_IDS = 2_000_000


def only_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is among ``ids``, which are counted first: a small set is broadcast, so that wide rows stay where
    they are read; beyond BROADCAST_IDS both sides are shuffled. ``ids`` should be materialized."""
    known = ids.select(key).distinct()
    return rows.join(F.broadcast(known) if known.count() <= BROADCAST_IDS else known, key, "left_semi")


def snapshot_order(df: DataFrame, snapshot: str) -> DataFrame:
    """(snapshot, ord): the snapshots that exist, numbered from 1. One row per snapshot, thus small."""
    ids = df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct()
    return ids.select(snapshot, F.row_number().over(Window.orderBy(snapshot)).alias("ord"))


def carry_forward(rows: DataFrame, key: str, fields: Sequence[str], failed: str) -> DataFrame:
    """Replace the state of failed rows by the one the key had in the snapshot just before.

    ``rows`` has one row per (key, ord). A key that is missing from a snapshot has no state to pass on, so states are
    carried only within unbroken stretches of snapshots; a failed row without anything to carry is left out.
    """
    by_key = Window.partitionBy(key).orderBy("ord")
    stretch = F.col("ord") - F.row_number().over(by_key)
    state = F.when(~F.col(failed), F.struct(*fields))
    within = Window.partitionBy(key, "stretch").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("stretch", stretch)
        .withColumn("state", F.last(state, ignorenulls=True).over(within))
        .where(F.col("state").isNotNull())
        .select(key, "ord", *[F.col(f"state.{f}").alias(f) for f in fields])
    )


def signed_cells(states: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, ord, field, value, sign): ``ord`` is the later snapshot of the pair that the cell counts in.

    The last snapshot opens a pair that has no later side; the caller drops it by joining the snapshots that exist.
    """
    cells = [F.struct(F.lit(PRESENCE).alias("field"), F.lit(None).cast("string").alias("value"))]
    cells += [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    sides = F.array(
        F.struct(F.col("ord").alias("ord"), F.lit(1).alias("sign")),
        F.struct((F.col("ord") + 1).alias("ord"), F.lit(-1).alias("sign")),
    )
    return (
        states.select(key, *fields, F.explode(sides).alias("side"))
        .where("side.ord >= 2")
        .select(key, F.col("side.ord").alias("ord"), F.col("side.sign").alias("sign"), F.inline(F.array(*cells)))
    )


def diff_snapshots(df: DataFrame, snapshot: str, key: str, fields: Sequence[str], order: Column, failed: Column | None = None) -> DataFrame:
    """Changes between consecutive snapshots: (snapshot, key, change_type, changed_fields).

    ``snapshot`` of the result is the later one of the pair; change_type is ``added``, ``removed`` or ``changed``.
    Of the rows of a key in a snapshot the one with the greatest ``order`` counts. Rows for which ``failed`` holds
    keep the state of the snapshot before. NULL values are values like any other; NULL keys and NULL snapshots are
    left out; repeated rows count once; an empty table or a single snapshot gives no rows; columns besides the named
    ones are ignored, whatever their names.
    """
    values = [f"_f{i}" for i in range(len(fields))]
    named = df.select(
        F.col(snapshot).alias("_snapshot"),
        F.col(key).alias("_key"),
        order.alias("_order"),
        F.coalesce(failed, F.lit(False)).alias("_failed") if failed is not None else F.lit(False).alias("_failed"),
        *[F.col(f).cast("string").alias(v) for f, v in zip(fields, values, strict=True)],
    ).where(F.col("_snapshot").isNotNull() & F.col("_key").isNotNull())
    ords = snapshot_order(df.select(F.col(snapshot).alias("_snapshot")), "_snapshot")
    latest = latest_rows(named, ["_key", "_snapshot"], [F.col("_order")], ["_failed", *values])
    states = carry_forward(latest.join(ords, "_snapshot"), "_key", values, "_failed")
    cells = signed_cells(states, "_key", values)
    left = cells.groupBy("_key", "ord", "field", "value").agg(F.sum("sign").alias("n")).where("n <> 0")
    presence = F.max(F.when(F.col("field") == PRESENCE, F.col("n")))
    names = F.create_map(*[x for f, v in zip(fields, values, strict=True) for x in (F.lit(v), F.lit(f))])
    changed = F.array_sort(F.collect_set(F.when(F.col("field") != PRESENCE, names[F.col("field")])))
    kinds = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    found = left.groupBy("_key", "ord").agg(presence.alias("presence"), changed.alias("fields"))
    return found.join(ords, "ord").select(
        F.col("_snapshot").alias(snapshot),
        F.col("_key").alias(key),
        kinds.alias("change_type"),
        F.when(F.col("presence").isNull(), F.col("fields")).alias("changed_fields"),
    )


def page_changes(page_records: DataFrame) -> DataFrame:
    """Added, removed and changed pages of each run: (run_id, page_id, change_type, changed_fields).

    A state is (version, stripped title, signature with its parts in order); a row with a ``fetch_error`` that is not
    blank failed, so its page keeps the state it had.
    """
    states = page_records.select(
        "run_id",
        to_id("id").alias("page_id"),
        "version",
        strip_white("title").alias("title"),
        canonical_signature("attachment_signature").alias("attachment_signature"),
        "crawled_at",
        "fetch_error",
    )
    failed = F.coalesce(strip_white("fetch_error"), F.lit("")) != ""
    return diff_snapshots(states, "run_id", "page_id", ["version", "title", "attachment_signature"], F.col("crawled_at"), failed)
