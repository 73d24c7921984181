"""Queries of a whole run over the test tables, and their SQL twins.

The run updates the records of the last snapshot: seeds are those of the runs so far, and the queries of content-by-label
macros are answered from the titles of live pages.
"""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from wikiloom.functions.files import attachment_path, page_filename
from wikiloom.operators import attachments as att, links, records, snapshots
from wikiloom.operators.comments import current_comments
from wikiloom.operators.ranking import rank_within
from wikiloom.plans import pipeline, render_sql
from wikiloom.plans.wiki import _ATT, _KINDS, _LAST, _PAGES, _SIG, _TARGETS, HOST, MAX_DEPTH, _attachments, _last, _NAMED
from wikiloom.plans.general import _strip
from wikiloom.session import materialize
from wikiloom.sources.tables import read_located, read_table

BASE = f"https://{HOST}/wiki"
NOW = datetime(2026, 1, 1)
_RECORD = (
    "title", "local_path", "version", "comment_count", "comments_fetch_error", "source_url", "canonical_url", "space_key", "depth", "outgoing_links", "incoming_links",
    "attachments", "attachment_signature", "storage_format_sample", "created_at", "last_modified_at", "created_by_id", "created_by_name", "last_modified_by_id",
    "last_modified_by_name", "confluence_parent_id",
)


def query_hits(spark: SparkSession, folder: str) -> DataFrame:
    """(cql, pos, page_id): for each query ``label = "word"`` the pages whose title has that word, by id.

    Stands in for the answers of a search service, which the test tables do not have.
    """
    rows = read_located(spark, folder, "api_pages").where("page_id IS NOT NULL")
    asked = snapshots.current_rows(rows, ["page_id"], [F.col("version.number")], rows.select("page_id", *snapshots.LOCATOR, links.label_queries_column("adf").alias("queries")))
    queries = asked.select(F.explode("queries").alias("cql")).distinct().withColumn("word", F.nullif(F.regexp_extract("cql", '^label = "([a-z]+)"$', 1), F.lit("")))
    titles = snapshots.current_rows(rows, ["page_id"], [F.col("version.number")], rows.select("page_id", "title", *snapshots.LOCATOR))
    words = titles.select("page_id", F.explode(F.array_distinct(F.split(F.lower("title"), "[^a-z]+"))).alias("word"))
    hits = rank_within(queries.join(words, "word").select("cql", "page_id"), "cql", ["page_id"], "n")
    return hits.select("cql", (F.col("n") - 1).cast("int").alias("pos"), "page_id")


def _inputs(spark: SparkSession, folder: str, previous: bool = True) -> pipeline.Inputs:
    seeds = read_table(spark, folder, "run_state").select(F.explode(records.string_list("seed_page_ids")).alias("s"), "run_id")
    given = [r.s for r in seeds.groupBy("s").agg(F.min("run_id").alias("n")).orderBy("n", "s").collect()]
    before = _last(spark, folder, *_RECORD) if previous else None
    related = materialize(query_hits(spark, folder))
    return pipeline.Inputs(*(read_table(spark, folder, f"api_{t}") for t in ("pages", "comments", "attachments", "users")), given, related, before)


def run_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What an update of the last snapshot would do with each page that it reaches, without doing it."""
    found = pipeline.run(_inputs(spark, folder), BASE, NOW, "updates", MAX_DEPTH, dry_run=True)
    return found.classified.select("page_id", "depth", "kind")


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records that an update of the last snapshot leaves: links, files, signature and origin of each."""
    found = pipeline.run(_inputs(spark, folder), BASE, NOW, "updates", MAX_DEPTH)
    return found.records.select(
        "id", "title", "version", "depth", F.array_join("outgoing_links", ",").alias("outgoing"), F.array_join("incoming_links", ",").alias("incoming"),
        F.coalesce(F.array_join("attachments", ","), F.lit("")).alias("attachments"), "attachment_signature", "comment_count", (F.col("crawled_at") == F.lit(NOW)).alias("fresh"),
    )


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of that run, one row."""
    found = pipeline.run(_inputs(spark, folder), BASE, NOW, "updates", MAX_DEPTH)
    files = {r.outcome: r["count"] for r in found.artifacts.groupBy("outcome").count().collect()}
    names = ("total", "deleted", "rerendered", "reused", "reachable", "succeeded", "failed", "pages_with_comments", "comments", "comments_failed", "attachments_stored", "attachments_kept")
    told = {n: int(found.metrics[n]) for n in names} | {f"files_{k}": int(files.get(k, 0)) for k in ("added", "updated", "deleted")}
    return spark.createDataFrame([tuple(told.values())], ", ".join(f"{n} bigint" for n in told))


def link_origins(spark: SparkSession, folder: str) -> DataFrame:
    """All links of each page in order: of its body, its comments, its children and its query hits."""
    given = _inputs(spark, folder, previous=False)
    rows = given.api_pages.where("page_id IS NOT NULL")
    linked = materialize(pipeline.sources_of_links(rows))
    talk = current_comments(given.api_comments, targets=links.targets_in("body"))
    parents = snapshots.latest_rows(rows, ["page_id"], [F.col("version.number")], ["parent_id"])
    edges = pipeline.all_edges(linked, parents, talk, given.related, HOST)
    lists = edges.groupBy("src").agg(links.ordered_ids(F.col("dst"), F.col("at")).alias("links"), F.max("at.origin").alias("last_origin"))
    return lists.select("src", F.array_join("links", ",").alias("links"), "last_origin")


def related_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of related pages that queries add to pages."""
    rows = read_table(spark, folder, "api_pages").where("page_id IS NOT NULL")
    linked = materialize(pipeline.sources_of_links(rows))
    titles = snapshots.latest_rows(rows, ["page_id"], [F.col("version.number")], ["title"])
    return pipeline.related_sections(linked, materialize(query_hits(spark, folder)), titles, BASE)


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """File name of each page by its title."""

    @F.pandas_udf("string")
    def name(title: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([page_filename(t or "", k) for t, k in zip(title, key, strict=True)], dtype=object)

    last = _last(spark, folder, "title")
    return last.select("id", name("title", "id").alias("file"))


def attachment_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Where the attachments of each page are stored, and how many could be."""
    done = att.outcomes(_attachments(spark, folder), 1).where("error IS NULL").select("page_id", attachment_path("filename").alias("path")).distinct()
    return done.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))


def stripped_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of the last snapshot behind their front matter, with that taken off again: a round trip."""
    last = _last(spark, folder, "storage_format_sample", "title", "source_url", "canonical_url", "space_key", "created_at", "created_by_name", "last_modified_at", "last_modified_by_name", "confluence_parent_id", "comment_count", "comments_fetch_error", "attachments")
    last = last.where("storage_format_sample IS NOT NULL")
    heads = records.front_matter(last.withColumn("is_seed", F.lit(False)))
    both = last.select("id", "storage_format_sample").join(heads, "id")
    return both.select("id", records.strip_front_matter(F.concat("front_matter", F.lit("\n\n"), "storage_format_sample")).alias("text"))


QUERIES = {f.__name__: f for f in (run_decisions, run_records, run_summary, link_origins, related_pages, page_files, attachment_paths, stripped_pages)}

_HITS = r"""asked AS (SELECT page_id, unnest(q) AS cql, generate_subscripts(q, 1) AS macro FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(adf, '"cql"\s*:\s*\{\s*"value"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), lambda x: replace(x, '\"', '"')), lambda x: x <> '') AS q FROM pages
  WHERE adf LIKE '%"contentbylabel"%' AND json_valid(adf))),
hits AS (SELECT cql, p.page_id, row_number() OVER (PARTITION BY cql ORDER BY p.page_id) - 1 AS pos FROM (SELECT DISTINCT cql, regexp_extract(cql, '^label = "([a-z]+)"$', 1) AS word FROM asked) q
  JOIN pages p ON q.word <> '' AND list_contains(regexp_split_to_array(lower(p.title), '[^a-z]+'), q.word))"""
_TALK = r"""talk AS (SELECT page_id, comment_id, body FROM api_comments WHERE trim(comment_id) <> '' QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY updated_at DESC NULLS LAST) = 1),
said AS (SELECT page_id, target, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, l, unnest(l) AS target FROM (
  SELECT page_id, list_concat(regexp_extract_all(body, '"href"\s*:\s*"([^"]+)"', 1), regexp_extract_all(body, '"url"\s*:\s*"([^"]+)"', 1)) AS l FROM talk)))"""
_DST = r"coalesce(TRY_CAST(nullif(regexp_extract(target, '[?&]pageId=([0-9]+)', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(target, '/spaces/[^/]+/pages/([0-9]+)', 1), '') AS BIGINT))"
_ORIGINS = f"""{_TARGETS}, {_HITS}, {_TALK},
placed AS (
  SELECT src, dst, 1 AS origin, pos AS a, 0 AS b FROM edges
  UNION ALL SELECT page_id, dst, 2, min(pos), 0 FROM (SELECT page_id, {_DST} AS dst, pos FROM said WHERE target LIKE '/%' OR starts_with(lower(target), 'https://{HOST}/')) WHERE dst > 0 GROUP BY ALL
  UNION ALL SELECT k.src, k.page_id, 3, 0, k.page_id FROM (SELECT page_id, TRY_CAST(nullif(trim(parent_id), '') AS BIGINT) AS src FROM pages) k JOIN pages p ON p.page_id = k.src AND regexp_matches(p.adf, '"extensionKey": ?"children"')
  UNION ALL SELECT a.page_id, h.page_id, 4, a.macro, h.pos FROM asked a JOIN hits h USING (cql)),
firsts AS (SELECT src, dst, min({{'o': origin, 'a': a, 'b': b}}) AS spot FROM placed GROUP BY ALL)"""
_RUN = f"""{_ORIGINS}, {_LAST}, {_ATT}, {_SIG}, {_KINDS.split(_SIG + ',')[1].strip()},
graph AS (SELECT src, dst, spot FROM firsts WHERE src NOT IN (SELECT page_id FROM kinds WHERE kind = 'clean')
  UNION ALL SELECT CAST(id AS BIGINT), dst, {{'o': 1, 'a': min(pos), 'b': 0}} FROM (SELECT id, TRY_CAST(trim(x) AS BIGINT) AS dst, pos FROM (SELECT id, unnest(outgoing_links) AS x, generate_subscripts(outgoing_links, 1) AS pos FROM last))
    WHERE dst > 0 AND CAST(id AS BIGINT) IN (SELECT page_id FROM kinds WHERE kind = 'clean') GROUP BY id, dst),
walks(page_id, depth) AS (
  SELECT DISTINCT CAST(s AS BIGINT), 0 FROM (SELECT unnest(seed_page_ids) AS s FROM run_state)
  UNION SELECT g.dst, w.depth + 1 FROM walks w JOIN pages p ON p.page_id = w.page_id AND lower(trim(p.status)) IS DISTINCT FROM 'trashed' JOIN graph g ON g.src = w.page_id WHERE w.depth < {MAX_DEPTH}),
told AS (SELECT w.page_id, min(w.depth) AS depth, any_value(CASE WHEN p.page_id IS NULL THEN 'deleted' ELSE k.kind END) AS kind FROM walks w LEFT JOIN kinds k USING (page_id) LEFT JOIN pages p USING (page_id) GROUP BY 1),
docs AS (SELECT CAST(page_id AS VARCHAR) AS k, adf FROM pages WHERE page_id IN (SELECT page_id FROM told WHERE kind = 'dirty')),
{render_sql.markdown_ctes('docs')},
gone AS (SELECT page_id FROM told WHERE kind = 'deleted'),
new_links AS (SELECT src, string_agg(dst, ',' ORDER BY spot) AS outgoing FROM graph WHERE dst NOT IN (SELECT page_id FROM gone) GROUP BY 1),
kept_links AS (SELECT id, string_agg(x, ',' ORDER BY pos) AS outgoing FROM (SELECT id, unnest(outgoing_links) AS x, generate_subscripts(outgoing_links, 1) AS pos FROM last) WHERE x NOT IN (SELECT CAST(page_id AS VARCHAR) FROM gone) GROUP BY 1),
files AS (SELECT page_id, string_agg(DISTINCT 'attachments/' || {_NAMED}, ',' ORDER BY 'attachments/' || {_NAMED}) AS attachments FROM att WHERE attachment_id <> '' GROUP BY 1),
spoken AS (SELECT page_id, count(*) AS n FROM talk GROUP BY 1),
recs AS (
  SELECT CAST(t.page_id AS VARCHAR) AS id, p.title, p.version.number AS version, t.depth, coalesce(n.outgoing, '') AS outgoing, coalesce(f.attachments, '') AS attachments,
    coalesce(s.signature, 'none') AS attachment_signature, CAST(coalesce(c.n, 0) AS INTEGER) AS comment_count, TRUE AS fresh, NULL AS old
  FROM told t JOIN pages p USING (page_id) JOIN rendered r ON r.k = CAST(t.page_id AS VARCHAR) LEFT JOIN new_links n ON n.src = t.page_id LEFT JOIN files f USING (page_id) LEFT JOIN sigs s USING (page_id) LEFT JOIN spoken c USING (page_id) WHERE t.kind = 'dirty'
  UNION ALL
  SELECT l.id, l.title, l.version, t.depth, coalesce(k.outgoing, ''), coalesce(array_to_string(l.attachments, ','), ''), CASE WHEN t.kind = 'clean' THEN coalesce(s.signature, 'none') ELSE l.attachment_signature END, l.comment_count, FALSE, t.kind
  FROM told t JOIN last l ON l.id = CAST(t.page_id AS VARCHAR) LEFT JOIN kept_links k ON k.id = l.id LEFT JOIN sigs s USING (page_id)
  WHERE t.kind = 'clean' OR (t.kind = 'dirty' AND l.id NOT IN (SELECT k FROM rendered)))"""
_SLUG = r"""trim(regexp_replace(regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(lower(coalesce(title, '')), '&', 'and'), '@', 'at'), '''', ''), '"', ''), '’', ''), 'ß', 'ss')), '[^a-z0-9_-]', '-', 'g'), '-{2,}', '-', 'g'), '-_')"""

SQL = {
    "run_decisions": f"WITH RECURSIVE {_RUN} SELECT page_id, depth, kind FROM told",
    "run_records": f"""WITH RECURSIVE {_RUN}, into_ AS (SELECT x AS id, string_agg(r.id, ',' ORDER BY r.id) AS incoming FROM (SELECT id, unnest(string_split(outgoing, ',')) AS x FROM recs) r GROUP BY 1)
SELECT r.* EXCLUDE (old), coalesce(i.incoming, '') AS incoming FROM recs r LEFT JOIN into_ i USING (id)""",
    "run_summary": f"""WITH RECURSIVE {_RUN}, now_ AS (SELECT t.kind, r.* FROM told t LEFT JOIN recs r ON r.id = CAST(t.page_id AS VARCHAR)),
paths AS (SELECT 1 AS k, coalesce(l.local_path, '') AS path FROM last l UNION SELECT 1, unnest(attachments) FROM last
  UNION SELECT 2, CASE WHEN r.fresh THEN coalesce(nullif({_SLUG.replace('title', 'r.title')}, ''), 'page') || '_' || r.id || '.md' ELSE l.local_path END FROM recs r LEFT JOIN last l USING (id) UNION SELECT 2, unnest(string_split(attachments, ',')) FROM recs),
outcomes AS (SELECT path, max(k) AS hi, min(k) AS lo FROM (SELECT k, trim(path) AS path FROM paths) WHERE path <> '' GROUP BY 1),
n AS (SELECT *, CASE WHEN attachments = '' OR attachments IS NULL THEN 0 ELSE len(string_split(attachments, ',')) END AS files FROM now_)
SELECT count(*) AS total, count(*) FILTER (kind = 'deleted') AS deleted, count(*) FILTER (kind = 'dirty') AS rerendered, count(*) FILTER (kind = 'clean') AS reused, count(*) FILTER (kind <> 'deleted') AS reachable,
  count(*) FILTER (kind = 'clean' OR (kind = 'dirty' AND coalesce(fresh, FALSE))) AS succeeded, count(*) FILTER (kind = 'dirty' AND NOT coalesce(fresh, FALSE)) AS failed,
  count(*) FILTER (fresh AND comment_count > 0) AS pages_with_comments, CAST(coalesce(sum(comment_count) FILTER (fresh), 0) AS BIGINT) AS comments, CAST(0 AS BIGINT) AS comments_failed,
  CAST(coalesce(sum(files) FILTER (fresh), 0) AS BIGINT) AS attachments_stored, CAST(coalesce(sum(files) FILTER (kind = 'clean'), 0) AS BIGINT) AS attachments_kept,
  (SELECT count(*) FROM outcomes WHERE lo = 2) AS files_added, (SELECT count(*) FROM outcomes WHERE lo = 1 AND hi = 2) AS files_updated, (SELECT count(*) FROM outcomes WHERE hi = 1) AS files_deleted FROM n""",
    "link_origins": f"WITH {_ORIGINS} SELECT src, string_agg(dst, ',' ORDER BY spot) AS links, max(spot.o) AS last_origin FROM firsts GROUP BY 1",
    "related_pages": f"""WITH {_PAGES}, {_HITS}, lines AS (SELECT a.page_id, a.macro, h.pos, '- [' || coalesce(nullif({_strip('p.title')}, ''), CAST(h.page_id AS VARCHAR)) || '](https://{HOST}/wiki/pages/viewpage.action?pageId=' || h.page_id || ')' || chr(10) AS line
  FROM asked a LEFT JOIN hits h USING (cql) LEFT JOIN pages p ON p.page_id = h.page_id),
sections AS (SELECT page_id, macro, chr(10) || chr(10) || '## Related pages' || chr(10) || chr(10) || coalesce(string_agg(line, '' ORDER BY pos), '') AS s FROM lines GROUP BY ALL)
SELECT page_id, string_agg(s, '' ORDER BY macro) AS related FROM sections GROUP BY 1""",
    "page_files": f"WITH {_LAST} SELECT id, coalesce(nullif({_SLUG}, ''), 'page') || '_' || id || '.md' AS file FROM last",
    "attachment_paths": f"WITH {_ATT}, f AS (SELECT DISTINCT page_id, 'attachments/' || {_NAMED} AS path FROM att WHERE attachment_id <> '' AND file_size <= 1048576) SELECT page_id, string_agg(path, ',' ORDER BY path) AS paths FROM f GROUP BY 1",
    "stripped_pages": f"WITH {_LAST} SELECT id, ltrim(storage_format_sample, chr(10)) AS text FROM last WHERE storage_format_sample IS NOT NULL",
}
