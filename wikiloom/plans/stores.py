"""Queries of sources and sinks: round trips through files, configuration and client policies, with their SQL twins.

Files are written below the shared checkpoint folder, one folder for each call.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from wikiloom.functions import urls
from wikiloom.functions.files import inside_folder
from wikiloom.operators import attachments as att, traversal
from wikiloom.plans.general import _strip
from wikiloom.plans.wiki import _ATT, _BFS, _LAST, _NAMED, HOST, MAX_DEPTH, MAX_MB, _attachments, _graph, _last, _seeds
from wikiloom.session import ensure_checkpoint_dir, materialize
from wikiloom.sources import client, store
from wikiloom.sources.config import Config, hook_command
from wikiloom.sources.tables import read_table

MAX_QUEUE = 3


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def stored_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the last snapshot, written as metadata, read, written as a snapshot, committed and read again."""
    at = _folder(spark)
    columns = [c.split()[0] for c in store.RECORD.split(", ")]
    store.write_metadata(_last(spark, folder, *[c for c in columns if c not in ("id", "crawled_at")]).select(*columns), f"{at}/metadata.json")
    store.commit(at, 7, store.write_snapshot(store.read_metadata(spark, f"{at}/metadata.json"), at, 7), {})
    found = store.read_snapshot(spark, at)
    return found.select("id", "title", "version", "local_path", "crawled_at", "created_at", F.array_join("outgoing_links", ",").alias("outgoing"), "confluence_parent_id", "storage_format_sample")


def exported_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of the last snapshot as files, and what is in those; a second export of the same pages writes none anew."""
    at = _folder(spark)
    pages = _last(spark, folder, "local_path", "storage_format_sample").where("trim(local_path) <> '' AND storage_format_sample IS NOT NULL")
    texts = materialize(pages.select(F.trim("local_path").alias("local_path"), F.col("storage_format_sample").alias("text")))
    store.clear_folder(at)
    store.write_pages(texts, at)
    store.write_pages(texts.select("local_path", F.lit("changed").alias("text"), F.lit(True).alias("keep")), at)
    files = spark.read.text(store.spark_path(at), wholetext=True, recursiveFileLookup=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), "([^/]+)$", 1).alias("file"), F.col("value").alias("text"))


def stored_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Attachments within the limit, copied from blobs that hold their own id, and what is in the copies."""
    at, known = _folder(spark), _attachments(spark, folder)
    planned = att.outcomes(known, MAX_MB)
    # Of files of one name in a page the least id is kept, so that the outcome does not depend on the order of tasks.
    first = planned.where("error IS NULL").groupBy("filename").agg(F.min("attachment_id").alias("attachment_id"), F.lit(None).cast("string").alias("error"))
    blobs = known.select("attachment_id", F.col("attachment_id").cast("binary").alias("content")).distinct()
    store.clear_folder(at)
    att.copy_blobs(first, blobs, at)
    copies = spark.read.format("binaryFile").load(store.spark_path(at))
    return copies.select(F.url_decode(F.regexp_extract("path", "([^/]+)$", 1)).alias("file"), F.col("content").cast("string").alias("content"))


def contained_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each attachment's own name would stay within an output folder."""

    @F.pandas_udf("boolean")
    def inside(s: pd.Series) -> pd.Series:
        return s.map(lambda x: inside_folder("/data/out", f"/data/out/{x}"))

    names = _attachments(spark, folder).select(F.col("filename").alias("name")).where("name IS NOT NULL").distinct()
    return names.select("name", inside("name").alias("inside"))


def config_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's address and title as the seed of a configuration: what is wrong with it, and its base address."""

    @F.pandas_udf("struct<errors: int, base: string>")
    def check(seeds: pd.Series) -> pd.DataFrame:
        rows = []
        for seed in seeds:
            config = Config.from_text(json.dumps({"seeds": [seed], "output_dir": "o"}), {"WIKI_USERNAME": "u", "WIKI_API_TOKEN": "t"})
            found = config.errors()
            rows.append((len(found), None if found else config.base_url()))
        return pd.DataFrame(rows, columns=["errors", "base"])

    seeds = _last(spark, folder, "source_url", "title").select(F.explode(F.array("source_url", "title")).alias("seed")).where("seed IS NOT NULL").distinct()
    return seeds.select("seed", check("seed").alias("c")).select("seed", "c.errors", "c.base")


def next_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's link as the next page of a listing: its address, and whether credentials may go there."""

    @F.pandas_udf("struct<next: string, ours: boolean>")
    def follow(links: pd.Series) -> pd.DataFrame:
        to = [client.next_url(f"https://{HOST}/wiki", x) for x in links]
        return pd.DataFrame({"next": to, "ours": [client.same_host(x, f"https://{HOST}") for x in to]})

    found = read_table(spark, folder, "api_pages").select(F.col("webui").alias("link")).where("link LIKE '/%' OR link LIKE 'http%'").distinct()
    return found.select("link", follow("link").alias("f")).select("link", "f.next", "f.ours")


def retry_delays(spark: SparkSession, folder: str) -> DataFrame:
    """Waits before further attempts: doubling for a busy service, what it asks for where it does, and the request budget."""
    asked = client.Response(429, headers={"Retry-After": "7"})
    now = [0.0]
    waits: list[float] = []

    def sleep(seconds: float) -> None:
        waits[-1] = seconds
        now[0] += seconds

    bucket = client.TokenBucket(120, 3, lambda: now[0], sleep)
    rows = []
    for n in range(14):
        waits.append(0.0)
        bucket.take()
        rows.append((n, client.retry_delay(n, 500, client.Response(503), lambda: 0.5), client.retry_delay(n, 500, asked), waits[-1]))
    return spark.createDataFrame(rows, "attempt int, busy double, asked double, budget double")


def queue_bound(spark: SparkSession, folder: str) -> DataFrame:
    """What a traversal reports that meets a level of more pages than it may queue."""
    edges, pages = _graph(spark, folder)
    seeds = _seeds(spark, folder).select(urls.seed_page_id("seed_id").alias("page_id"))
    try:
        traversal.traverse(seeds, edges, MAX_DEPTH, traversal.page_handler(pages), MAX_QUEUE)
        rows = []
    except traversal.FrontierTooLarge as e:
        rows = [(e.depth, e.size, ",".join(map(str, e.sample)))]
    return spark.createDataFrame(rows, "depth int, pages bigint, sample string")


def hook_commands(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's attachments as the command of a hook: blank arguments are dropped, others stripped."""

    @F.pandas_udf("string")
    def command(args: pd.Series) -> pd.Series:
        return args.map(lambda a: "|".join(hook_command(list(a))))

    rows = _last(spark, folder, "attachments", "title").where("attachments IS NOT NULL AND title IS NOT NULL")
    return rows.select("id", command(F.concat(F.array("title", F.lit(" ")), "attachments")).alias("command"))


QUERIES = {f.__name__: f for f in (stored_records, exported_pages, stored_attachments, contained_paths, config_checks, next_addresses, retry_delays, queue_bound, hook_commands)}

_STEPS = "list_transform(string_split(name, '/'), lambda x: CASE x WHEN '..' THEN -1 WHEN '.' THEN 0 WHEN '' THEN 0 ELSE 1 END)"

SQL = {
    "stored_records": f"""WITH {_LAST} SELECT id, title, version, local_path, crawled_at, created_at, array_to_string(outgoing_links, ',') AS outgoing, confluence_parent_id, storage_format_sample FROM last""",
    "exported_pages": f"WITH {_LAST} SELECT trim(local_path) AS file, storage_format_sample AS text FROM last WHERE trim(local_path) <> '' AND storage_format_sample IS NOT NULL",
    "stored_attachments": f"WITH {_ATT} SELECT {_NAMED} AS file, min(attachment_id) AS content FROM att WHERE attachment_id <> '' AND file_size <= {MAX_MB * 1024 * 1024} GROUP BY 1",
    "contained_paths": f"""WITH {_ATT} SELECT DISTINCT filename AS name, list_min(list_transform(range(1, len(string_split(filename, '/')) + 1), lambda i: list_sum({_STEPS.replace('name', 'filename')}[1:i]))) >= 0 AS inside FROM att WHERE filename IS NOT NULL""",
    "config_checks": f"""WITH {_LAST}, s AS (SELECT DISTINCT unnest([source_url, title]) AS seed FROM last), p AS (SELECT seed, regexp_extract({_strip('seed')}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]+)([^?#]*)', ['scheme', 'host', 'path']) AS u FROM s WHERE seed IS NOT NULL)
SELECT seed, CAST(u.host = '' AS INTEGER) AS errors, CASE WHEN u.host <> '' THEN lower(u.scheme) || '://' || u.host || CASE WHEN len(list_filter(string_split(u.path, '/'), lambda x: x <> '')) >= 2 THEN '/' || list_filter(string_split(u.path, '/'), lambda x: x <> '')[1] ELSE '' END END AS base FROM p""",
    "next_addresses": f"""SELECT DISTINCT webui AS link, CASE WHEN starts_with(webui, '/') THEN 'https://{HOST}' || webui ELSE webui END AS next, starts_with(webui, '/') OR lower(regexp_extract(webui, '^https?://([^/?#]*)', 1)) = '{HOST}' AS ours FROM api_pages WHERE webui LIKE '/%' OR webui LIKE 'http%'""",
    "retry_delays": "SELECT CAST(n AS INTEGER) AS attempt, CAST(0.5 * pow(2, least(n, 10)) AS DOUBLE) AS busy, CAST(7 AS DOUBLE) AS asked, CAST(CASE WHEN n >= 3 THEN 0.5 ELSE 0 END AS DOUBLE) AS budget FROM range(14) t(n)",
    "queue_bound": f"""WITH RECURSIVE {_BFS}, big AS (SELECT depth, count(*) AS pages FROM bfs WHERE depth > 0 GROUP BY 1 HAVING count(*) > {MAX_QUEUE} ORDER BY 1 LIMIT 1)
SELECT CAST(depth AS INTEGER) AS depth, pages, (SELECT string_agg(page_id, ',' ORDER BY page_id) FROM (SELECT page_id FROM bfs WHERE bfs.depth = big.depth ORDER BY page_id LIMIT 20)) AS sample FROM big""",
    "hook_commands": f"""WITH {_LAST} SELECT id, array_to_string(list_filter(list_transform(list_concat([title, ' '], attachments), lambda x: {_strip('x')}), lambda x: x <> ''), '|') AS command FROM last WHERE attachments IS NOT NULL AND title IS NOT NULL""",
}
