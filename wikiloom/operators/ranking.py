"""Positions within groups of any size.

Rows are laid out by range of (group, order), so a group that holds a third of all rows spreads over many tasks; each
task numbers its own stretch, and the stretches of a group are shifted by the sizes of those before them. Only one row
per stretch is looked at besides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wikiloom.session import materialize


def rank_within(df: DataFrame, group: str, order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with the position (from 1) of each row within its group in a further column.

    ``order`` should settle all ties; those that it leaves are numbered in no particular order. NULL groups are one
    group. The rows are written to the shared checkpoint folder once, since the layout must be the same for the count
    and for the numbers.
    """
    laid = materialize(df.repartitionByRange(group, *order).withColumn("_stretch", F.spark_partition_id()))
    sizes = laid.groupBy(F.col(group).alias("_group"), "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_stretch")
    ahead = sizes.withColumn("_ahead", F.sum("_n").over(before) - F.col("_n")).select("_group", F.col("_stretch").alias("_s"), "_ahead")
    own = laid.withColumn("_rn", F.row_number().over(Window.partitionBy("_stretch", group).orderBy(*order)))
    joined = own.join(ahead, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_stretch") == F.col("_s")))
    return joined.withColumn(name, (F.col("_rn") + F.col("_ahead")).cast("bigint")).select(*df.columns, name)
