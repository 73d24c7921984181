"""Attachments: signatures, outcomes, copying."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wikiloom.functions.files import attachment_filename
from wikiloom.functions.text import strip_white
from wikiloom.operators.snapshots import latest_rows

_PARTS = ("attachment_id", "filename", "media_type", "file_size")


def clean_attachments(api_attachments: DataFrame) -> DataFrame:
    """One row per attachment, texts stripped; of repeated rows the greatest counts."""
    texts = {c: strip_white(c) for c in ("attachment_id", "filename", "media_type", "file_id")}
    rows = api_attachments.withColumns(texts).where("page_id IS NOT NULL")
    return latest_rows(rows, ["page_id", "attachment_id"], [], ["filename", "media_type", "file_size", "file_id"])


def signatures(attachments: DataFrame) -> DataFrame:
    """(page_id, signature): sorted ``id|name|type|size`` joined by ``;``. Pages without attachments have no row; their
    signature is ``none``."""
    part = F.concat_ws("|", *[F.coalesce(strip_white(F.col(c).cast("string")), F.lit("")) for c in _PARTS])
    return attachments.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(part)), ";").alias("signature"))


def outcomes(attachments: DataFrame, max_mb: int) -> DataFrame:
    """(page_id, attachment_id, original_name, filename, file_id, skipped, error) of a download that is not run.

    Checks come in this order: size limit (0 is none), then a blank id.
    """
    big = (F.lit(max_mb) > 0) & (F.coalesce("file_size", F.lit(0)) > max_mb * 1024 * 1024)
    error = F.when(big, F.concat(F.lit("size "), F.col("file_size").cast("string"), F.lit(f" exceeds the limit of {max_mb * 1024 * 1024} bytes"))).when(
        F.coalesce(strip_white("attachment_id"), F.lit("")) == "", "no attachment id"
    )
    return attachments.select(
        "page_id",
        "attachment_id",
        F.col("filename").alias("original_name"),
        F.when(error.isNull(), attachment_filename("page_id", "filename")).alias("filename"),
        F.when(error.isNull(), F.col("file_id")).alias("file_id"),
        F.coalesce(big, F.lit(False)).alias("skipped"),
        error.alias("error"),
    )


def read_blobs(spark, folder: str, max_bytes: int = 0) -> DataFrame:
    """(attachment_id, content) of the files of a folder, which are named by attachment id; those over the limit are left
    out before their content is read."""
    files = spark.read.format("binaryFile").load(folder)
    files = files.where(F.col("length") <= max_bytes) if max_bytes else files
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("attachment_id"), "content")


def copy_blobs(planned: DataFrame, blobs: DataFrame, folder: str) -> None:
    """Write planned(filename, attachment_id, error) from blobs(attachment_id, content) into a folder; failed ones are
    left out."""
    from wikiloom.sources.store import write_blobs

    write_blobs(planned.where("error IS NULL").join(blobs, "attachment_id").select("filename", "content"), folder)
