"""Readers for the Parquet tables of a corpus folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_located(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with the place of each row (see ``operators.snapshots.LOCATOR``), from what the Parquet reader knows."""
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    return read_table(spark, folder, name).select("*", *place)


def last_value(df: DataFrame, column: str):
    """Greatest value of a column, from the footer statistics where the source keeps them; one value to the driver."""
    return df.agg({column: "max"}).first()[0]
