"""Snapshots and pages as files: metadata documents, validated on the way in, and snapshots behind an atomic pointer.

Single files go through :mod:`pyarrow.fs`, so the output folder may be a path that all executors mount or a URI of a
distributed file system. A file is written under a name of its own for each attempt and then moved, so neither a reader
nor a second attempt of the same task ever meets a part.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from wikiloom.functions.files import inside_folder
from wikiloom.operators.records import record_errors

POINTER = "CURRENT"

RECORD = (
    "id string, title string, local_path string, version int, crawled_at timestamp, comment_count int, comments_last_fetched timestamp, "
    "comments_fetch_error string, source_url string, canonical_url string, space_key string, depth int, fetch_error string, "
    "outgoing_links array<string>, incoming_links array<string>, attachments array<string>, attachment_signature string, "
    "storage_format_sample string, created_at timestamp, last_modified_at timestamp, created_by_id string, created_by_name string, "
    "last_modified_by_id string, last_modified_by_name string, confluence_parent_id bigint"
)
DOCUMENT = f"crawl_started_at timestamp, seed_page_ids array<string>, pages map<string, struct<{RECORD.replace(' ', ':').replace(',:', ', ')}>>"


def filesystem(folder: str):
    """File system of a folder, and the folder's path on it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), os.path.abspath(folder)


def exists(fs, path: str) -> bool:
    return fs.get_file_info(path).type.name != "NotFound"


def write_bytes(fs, path: str, content: bytes) -> None:
    """Write a file whole: under a name that no other attempt has, then moved to its own."""
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, path)


def write_text(folder: str, name: str, text: str) -> None:
    fs, base = filesystem(folder)
    write_bytes(fs, posixpath.join(base, name), text.encode("utf-8"))


def read_text(folder: str, name: str) -> str | None:
    """A file's text; None where it is not there."""
    fs, base = filesystem(folder)
    path = posixpath.join(base, name)
    if not exists(fs, path):
        return None
    with fs.open_input_stream(path) as f:
        return f.read().decode("utf-8")


def within(base: str, name: str) -> str:
    """Path of a file below ``base``; raises if it would lie elsewhere."""
    path = posixpath.normpath(posixpath.join(base, name))
    if not inside_folder(base, path):
        raise ValueError(f"{name} is outside of {base}")
    return path


def spark_path(folder: str) -> str:
    """A folder as Spark is told it: a plain path is a local one."""
    return folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Records of a metadata document, or of the JSON lines that :func:`write_metadata` gives; what is malformed or fails
    validation raises."""
    fs, at = filesystem(path)
    if fs.get_file_info(at).type.name == "Directory":
        entries = spark.read.schema(f"key string, record struct<{RECORD}>").json(spark_path(path), mode="FAILFAST").select("key", "record.*")
    else:
        text = spark.read.text(spark_path(path), wholetext=True)
        parsed = text.select(F.from_json("value", DOCUMENT, {"mode": "FAILFAST"}).alias("d"))
        entries = parsed.select(F.explode("d.pages").alias("key", "r")).select("key", "r.*")
    if bad := record_errors(entries).limit(1).collect():
        raise ValueError(f"metadata entry {bad[0].key!r}: {bad[0].error}")
    unset = F.to_timestamp(F.lit("0001-01-01T00:00:00Z"))
    return entries.drop("key").select(*[F.nullif(c, unset).alias(c) if t == "timestamp" else F.col(c) for c, t in entries.drop("key").dtypes])


def write_metadata(records: DataFrame, path: str) -> None:
    """Records as JSON lines (key, record), one file per task: a single document would not survive growth."""
    rows = records.select(F.col("id").alias("key"), F.struct(*records.columns).alias("record"))
    rows.write.mode("overwrite").json(spark_path(path), timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def write_snapshot(records: DataFrame, folder: str, run_id: int) -> str:
    """Write a snapshot under its own name, which nobody reads before :func:`commit` points to it."""
    name = f"snapshot_run={run_id}"
    records.write.mode("overwrite").parquet(f"{spark_path(folder)}/{name}")
    return name


def commit(folder: str, run_id: int, name: str, checkpoints: dict) -> None:
    """Make a snapshot and the checkpoints that belong to it current, in one move."""
    write_text(folder, POINTER, json.dumps({"run_id": run_id, "snapshot": name, "checkpoints": checkpoints}, indent=2))


def current(folder: str) -> dict:
    """What :func:`commit` left; empty before the first run."""
    return json.loads(read_text(folder, POINTER) or "{}")


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """The current snapshot; None before the first one."""
    name = current(folder).get("snapshot")
    return spark.read.parquet(f"{spark_path(folder)}/{name}") if name else None


def clear_folder(folder: str) -> None:
    """Empty an output folder; refuses names that could not be one."""
    if folder.strip() in ("", ".", "/"):
        raise ValueError(f"refusing to clear {folder!r}")
    fs, base = filesystem(folder.strip())
    if base.strip("/") == "":
        raise ValueError(f"refusing to clear {folder!r}")
    fs.create_dir(base, recursive=True)
    fs.delete_dir_contents(base)


def write_pages(pages: DataFrame, folder: str) -> None:
    """One file per page of pages(local_path, text); rows with ``keep`` are written only where their file is missing."""
    keep = F.col("keep") if "keep" in pages.columns else F.lit(False).alias("keep")

    def write(part) -> None:
        fs, base = filesystem(folder)
        for row in part:
            target = within(base, row.local_path)
            if not (row.keep and exists(fs, target)):
                write_bytes(fs, target, row.text.encode("utf-8"))

    pages.select("local_path", "text", keep).foreachPartition(write)


def write_blobs(files: DataFrame, folder: str) -> None:
    """One file per row of files(filename, content)."""

    def write(part) -> None:
        fs, base = filesystem(folder)
        for row in part:
            write_bytes(fs, within(base, row.filename), bytes(row.content))

    files.select("filename", "content").foreachPartition(write)


def remove_files(paths: DataFrame, folder: str) -> None:
    """Remove the files of paths(path) that are there."""

    def remove(part) -> None:
        fs, base = filesystem(folder)
        for row in part:
            target = posixpath.normpath(posixpath.join(base, row.path))
            if inside_folder(base, target) and exists(fs, target):
                fs.delete_file(target)

    paths.select("path").foreachPartition(remove)


def missing_files(paths: DataFrame, folder: str) -> DataFrame:
    """The rows of paths(path, ...) whose file is not there; looked up where the rows are."""

    @F.pandas_udf("boolean")
    def there(s: pd.Series) -> pd.Series:
        fs, base = filesystem(folder)
        return pd.Series([exists(fs, posixpath.join(base, x)) if x else False for x in s])

    return paths.where(~there("path"))
