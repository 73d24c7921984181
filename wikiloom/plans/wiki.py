"""Queries of the wiki operators, each over its whole tables, and their SQL twins, written independently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wikiloom.functions import urls
from wikiloom.functions.files import attachment_filename, managed_path
from wikiloom.functions.text import canonical_signature, strip_white
from wikiloom.operators import attachments as att, comments as com, incremental, links, records, render, snapshots, traversal
from wikiloom.plans import render_sql
from wikiloom.plans.general import _strip
from wikiloom.session import materialize
from wikiloom.sources.tables import last_value, read_located, read_table

HOST, ORIGIN, MAX_DEPTH, MAX_MB = "wiki.example.org", "https://wiki.example.org", 3, 1
_CARRIED = ("title", "local_path", "version", "outgoing_links", "incoming_links", "attachments", "attachment_signature", "depth")
_HEAD = (
    "title", "source_url", "canonical_url", "space_key", "created_at", "created_by_name", "last_modified_at", "last_modified_by_name",
    "confluence_parent_id", "comment_count", "comments_fetch_error", "attachments",
)


def _extracted(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    """page_id and what ``columns`` make of the current row of each page.

    They are worked out where the rows are read; only their results and the rows' places are shuffled, no body.
    """
    rows = read_located(spark, folder, "api_pages").where("page_id IS NOT NULL")
    made = rows.select("page_id", *snapshots.LOCATOR, *[c.alias(n) for n, c in columns.items()])
    return snapshots.current_rows(rows, ["page_id"], [F.col("version.number")], made)


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, targets) of the current row of each page."""
    return _extracted(spark, folder, targets=links.targets_in("adf"))


def _narrow(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Current row of each page, with some of its columns only: the bodies are neither read nor shuffled."""
    rows = read_table(spark, folder, "api_pages").where("page_id IS NOT NULL")
    return snapshots.latest_rows(rows, ["page_id"], [F.col("version.number")], list(columns))


def _last(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Records of the last snapshot with the columns that are asked for; others are neither read nor shuffled."""
    table = read_table(spark, folder, "page_records")
    return records.snapshot_records(table.select("run_id", "id", "crawled_at", *columns), last_value(table, "run_id"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return links.edges(_targets(spark, folder), "page_id", "targets", HOST)


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "run_state").select(F.posexplode(records.string_list("seed_page_ids")).alias("pos", "seed_id"))
    return rows.groupBy("seed_id").agg(F.min("pos").alias("pos"))


def _attachments(spark: SparkSession, folder: str) -> DataFrame:
    return att.clean_attachments(read_table(spark, folder, "api_attachments"))


def link_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder).select("src", "dst")


def link_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Links of each page by class; seen from another host, absolute links are external."""
    seen = links.external_counts(_targets(spark, folder), "page_id", "targets", "other.example.org:8443")
    return seen.select("page_id", "links", "external")


def outgoing_links(spark: SparkSession, folder: str) -> DataFrame:
    return links.outgoing(_edges(spark, folder)).select("src", F.array_join("outgoing", ",").alias("outgoing"))


def incoming_links(spark: SparkSession, folder: str) -> DataFrame:
    found = links.incoming(_last(spark, folder, "outgoing_links").select("id", "outgoing_links"), "id", "outgoing_links")
    return found.select("id", F.array_join("incoming", ",").alias("incoming"))


def bfs_depth(spark: SparkSession, folder: str) -> DataFrame:
    return _reached(spark, folder).select("page_id", "depth", "state")


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Edges of the last snapshot's records, and its pages with the status that the API has for them."""
    last = _last(spark, folder, "outgoing_links").select(F.col("id").try_cast("bigint").alias("page_id"), "outgoing_links")
    edge_rows = last.select(F.col("page_id").alias("src"), F.explode(links.parse_ids("outgoing_links")).alias("dst"))
    return materialize(edge_rows), materialize(last.select("page_id").join(_narrow(spark, folder, "status"), "page_id", "left"))


def _reached(spark: SparkSession, folder: str) -> DataFrame:
    return _walk(spark, folder, *_graph(spark, folder))


def _walk(spark: SparkSession, folder: str, edge_rows: DataFrame, pages: DataFrame) -> DataFrame:
    seeds = _seeds(spark, folder).select(urls.seed_page_id("seed_id").alias("page_id"))
    return traversal.traverse(seeds, edge_rows, MAX_DEPTH, traversal.page_handler(pages))


def crawl_stats(spark: SparkSession, folder: str) -> DataFrame:
    graph = _graph(spark, folder)
    reached = materialize(_walk(spark, folder, *graph))
    # Bodies are looked into for the pages that were reached only; what is read of them are their links.
    rows = read_located(spark, folder, "api_pages").where("page_id IS NOT NULL")
    near = snapshots.only_ids(rows, reached.where("state = 'ok'"), "page_id")
    found = snapshots.current_rows(rows, ["page_id"], [F.col("version.number")], near.select("page_id", *snapshots.LOCATOR, links.targets_in("adf").alias("targets")))
    return traversal.crawl_stats(reached, graph[0], links.external_counts(found, "page_id", "targets", HOST))


def depth_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return traversal.depth_distribution(_reached(spark, folder))


def _deleted(spark: SparkSession, folder: str) -> DataFrame:
    return _narrow(spark, folder, "status").where(F.lower(strip_white("status")) == "trashed").select("page_id")


def prune_deleted_links(spark: SparkSession, folder: str) -> DataFrame:
    found = links.without_deleted(_last(spark, folder, "outgoing_links").select("id", "outgoing_links"), "id", "outgoing_links", _deleted(spark, folder))
    return found.select("id", F.array_join("outgoing", ",").alias("outgoing"))


def prune_metadata(spark: SparkSession, folder: str) -> DataFrame:
    gone = F.lower(strip_white("status")) == "trashed"
    crawled = _narrow(spark, folder, "status").select("page_id", F.when(gone, "deleted").otherwise("ok").alias("state"))
    return records.prune(_last(spark, folder), crawled).select("id")


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    prev = _last(spark, folder, "title", "version", "attachment_signature").select(F.col("id").try_cast("bigint").alias("page_id"), "title", "version", F.col("attachment_signature").alias("signature"))
    live = _narrow(spark, folder, "title", "status", "version").select(
        "page_id", strip_white("title").alias("title"), "status", F.col("version.number").alias("version"), F.lit(True).alias("found"), F.lit(None).cast("string").alias("error")
    )
    signed = live.join(att.signatures(_attachments(spark, folder)), "page_id", "left").withColumn("signature", F.coalesce("signature", F.lit("none")))
    everything = prev.select("page_id").unionByName(signed.select("page_id")).distinct().join(signed, "page_id", "left")
    return incremental.classify_pages(everything, prev)


def dirty_clean_deleted(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder).select("page_id", "kind")


def updates_summary(spark: SparkSession, folder: str) -> DataFrame:
    return records.run_metrics(_classified(spark, folder))


def carry_over_records(spark: SparkSession, folder: str) -> DataFrame:
    found = _classified(spark, folder).withColumn("depth", F.lit(0))
    kept = records.carry_over(found, _last(spark, folder, *_CARRIED))
    return kept.select("page_id", "version", "attachment_signature", F.array_join(links.parse_ids("outgoing_links").cast("array<string>"), ",").alias("outgoing"), "error")


def attachment_signature(spark: SparkSession, folder: str) -> DataFrame:
    return att.signatures(_attachments(spark, folder))


def attachment_names(spark: SparkSession, folder: str) -> DataFrame:
    return _attachments(spark, folder).select("page_id", "attachment_id", attachment_filename("page_id", "filename").alias("filename"))


def attachment_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    done = att.outcomes(_attachments(spark, folder), MAX_MB)
    return done.groupBy("skipped", (F.col("error").isNull()).alias("stored")).agg(F.count("*").alias("files"))


def artifact_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    table = read_table(spark, folder, "page_records")
    last = last_value(table, "run_id")
    before = last_value(table.where(F.col("run_id") < last), "run_id")
    pick = lambda run: records.snapshot_records(table.select("run_id", "id", "crawled_at", "local_path", "attachments"), run)
    return records.reconcile(pick(before), pick(last))


def seed_flags(spark: SparkSession, folder: str) -> DataFrame:
    return records.seed_flags(_last(spark, folder).select("id"), _seeds(spark, folder))


def seed_index(spark: SparkSession, folder: str) -> DataFrame:
    return records.index_lines(_last(spark, folder, "title", "local_path", "source_url"), _seeds(spark, folder))


def author_names(spark: SparkSession, folder: str) -> DataFrame:
    names = com.users(read_table(spark, folder, "api_users"))
    pages = _narrow(spark, folder, "author_id", "version").select("page_id", strip_white("author_id").alias("author_id"), strip_white("version.author_id").alias("editor_id"))
    return com.with_author(com.with_author(pages, names, "author_id", "author"), names, "editor_id", "editor").select("page_id", "author", "editor")


def comment_order(spark: SparkSession, folder: str) -> DataFrame:
    found = com.ordered_comments(com.current_comments(read_located(spark, folder, "api_comments")))
    return found.select("page_id", "comment_id", "position", "depth")


def comments_markdown(spark: SparkSession, folder: str) -> DataFrame:
    names = com.users(read_table(spark, folder, "api_users"))
    table = read_located(spark, folder, "api_comments")
    ordered = com.ordered_comments(com.current_comments(table))
    texts = com.current_comments(table, text=com.comment_text("body"))
    return com.comments_markdown(com.comment_blocks(com.with_author(ordered, names, "author_id", "author"), texts))


def rendered_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown of every live page: rendered, titled, with absolute links."""
    alive = F.coalesce(F.lower(strip_white("status")), F.lit("")) != "trashed"
    text = _extracted(spark, folder, title=F.col("title"), markdown=render.rendered(F.col("adf")), alive=alive).where("alive AND markdown IS NOT NULL")
    return text.select("page_id", links.absolutize(render.with_title(F.col("markdown"), F.col("title")), ORIGIN).alias("markdown"))


def rendered_user_cards(spark: SparkSession, folder: str) -> DataFrame:
    """A small document for each user: heading, list, marks and table, rendered."""
    u = com.users(read_table(spark, folder, "api_users")).where("name IS NOT NULL")
    text = lambda v, *marks: F.struct(F.lit("text").alias("type"), v.alias("text"), F.array(*[F.struct(F.lit(m).alias("type")) for m in marks] or [F.struct(F.lit("none").alias("type"))]).alias("marks"))
    node = lambda kind, *kids: F.struct(F.lit(kind).alias("type"), F.array(*kids).alias("content"))
    name, key = F.col("name"), F.col("account_id")
    para = lambda t: node("paragraph", t)
    parts = [
        node("heading", text(name)),
        node("bulletList", node("listItem", para(text(key, "code"))), node("listItem", para(text(name, "em", "strong")))),
        node("table", node("tableRow", node("tableHeader", para(text(F.lit("id")))), node("tableHeader", para(text(F.lit("name"))))), node("tableRow", node("tableCell", para(text(key))), node("tableCell", para(text(name))))),
    ]
    adf = F.concat(F.lit('{"type":"doc","content":['), F.concat_ws(",", *[F.to_json(p) for p in parts]), F.lit("]}"))
    return u.select("account_id", strip_white(render.rendered(adf)).alias("markdown"))


def _link_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One text per page: its links as Markdown, labelled with their own URL."""
    targets = links.link_targets(_targets(spark, folder), "page_id", "targets")
    line = F.concat(F.lit("["), F.col("target"), F.lit("]("), F.col("target"), F.lit(")"))
    lists = targets.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"))
    return lists.select("page_id", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("markdown"))


def label_enrich(spark: SparkSession, folder: str) -> DataFrame:
    lines = _link_lines(spark, folder)
    absolute = lines.select("page_id", F.replace("markdown", F.lit("[/wiki"), F.lit(f"[{ORIGIN}/wiki")).alias("m")).select("page_id", links.absolutize("m", ORIGIN).alias("markdown"))
    titles = _last(spark, folder, "title").select(F.col("id").try_cast("bigint").alias("page_id"), "title")
    return links.enrich_labels(absolute, "page_id", "markdown", titles)


def absolutize_links(spark: SparkSession, folder: str) -> DataFrame:
    return _link_lines(spark, folder).select("page_id", links.absolutize("markdown", ORIGIN).alias("markdown"))


def rewrite_links(spark: SparkSession, folder: str) -> DataFrame:
    last = _last(spark, folder, "local_path", "storage_format_sample")
    paths = _last(spark, folder, "local_path").select(F.col("id").try_cast("bigint").alias("page_id"), managed_path("local_path").alias("local_path")).where("local_path IS NOT NULL")
    return links.rewrite(last.select("id", "storage_format_sample"), "id", "storage_format_sample", paths)


def rewrite_stats(spark: SparkSession, folder: str) -> DataFrame:
    return links.rewrite_stats(rewrite_links(spark, folder))


def attachment_links(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of the last snapshot with links to attachments of the page, by file id or name."""
    results = att.outcomes(_attachments(spark, folder), 0).withColumn("id", F.col("page_id").cast("string")).drop("page_id")
    texts = _last(spark, folder, "storage_format_sample").select("id", "storage_format_sample").where(F.col("storage_format_sample").contains("](attachment://"))
    return links.rewrite_attachments(texts, "id", "storage_format_sample", results)


def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    last = _last(spark, folder, *_HEAD)
    return records.front_matter(records.seed_flags(last, _seeds(spark, folder)))


def seed_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Page id and space key of each page's URLs, read as seeds."""
    seeds = _last(spark, folder, "source_url", "canonical_url").select(F.explode(F.array("source_url", "canonical_url", "id")).alias("seed")).where("seed IS NOT NULL").distinct()
    return seeds.select("seed", urls.seed_page_id("seed").alias("page_id"), urls.space_key("seed").alias("space_key"))


def children_by_parent(spark: SparkSession, folder: str) -> DataFrame:
    rows = _narrow(spark, folder, "parent_id").select("page_id", urls.whole_number(strip_white("parent_id")).alias("parent_id")).where("parent_id > 0")
    return rows.groupBy("parent_id").agg(F.count("*").alias("children"), F.min("page_id").alias("first_child"), F.max("page_id").alias("last_child"))


def macro_flags(spark: SparkSession, folder: str) -> DataFrame:
    by_label = F.coalesce(F.col("adf").contains('"contentbylabel"'), F.lit(False))
    return _extracted(spark, folder, children=F.coalesce(links.has_children_macro("adf"), F.lit(False)), by_label=by_label)


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    asked = _extracted(spark, folder, queries=links.label_queries_column("adf"))
    return asked.select("page_id", F.explode("queries").alias("query")).groupBy("query").agg(F.count("*").alias("uses"))


def checkpoint_state(spark: SparkSession, folder: str) -> DataFrame:
    """Runs, whether they succeeded, and errors of their checkpoints."""
    state = read_table(spark, folder, "run_state")
    bad = records.checkpoint_errors(state).groupBy("run_id").agg(F.count("*").alias("errors"))
    ok = F.coalesce(F.col("last_successful.started") == F.col("crawl_started_at"), F.lit(False))
    runs = state.groupBy("run_id").agg(F.bool_or(ok).alias("succeeded"))
    return runs.join(bad, "run_id", "left").select("run_id", "succeeded", F.coalesce("errors", F.lit(0)).alias("errors"))


def parsed_times(spark: SparkSession, folder: str) -> DataFrame:
    return _narrow(spark, folder, "created_at").select("page_id", urls.parse_time("created_at").alias("created_at"))


def renamed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose title differs between the last two snapshots, with both titles."""
    table = read_table(spark, folder, "page_records").select("run_id", "id", "crawled_at", "title")
    last = last_value(table, "run_id")
    before = last_value(table.where(F.col("run_id") < last), "run_id")
    new, old = (records.snapshot_records(table, r).select("id", strip_white("title").alias(n)) for r, n in ((last, "title"), (before, "old_title")))
    return new.join(old, "id").where("title <> old_title")


def spaces(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, failures and signatures per space in the last snapshot."""
    rows = _last(spark, folder, "space_key", "fetch_error", "attachment_signature").select("space_key", "fetch_error", canonical_signature("attachment_signature").alias("s"))
    return rows.groupBy("space_key").agg(F.count("*").alias("pages"), F.count_if(strip_white("fetch_error") != "").alias("failed"), F.count("s").alias("signed"))


QUERIES = {
    f.__name__: f
    for f in (
        link_edges, link_classes, outgoing_links, incoming_links, bfs_depth, crawl_stats, depth_distribution, prune_deleted_links, prune_metadata,
        dirty_clean_deleted, updates_summary, carry_over_records, attachment_signature, attachment_names, attachment_outcomes, artifact_reconcile,
        seed_flags, seed_index, author_names, comment_order, comments_markdown, rendered_pages, rendered_user_cards, label_enrich, absolutize_links,
        rewrite_links, rewrite_stats, attachment_links, front_matter, seed_resolve, children_by_parent, macro_flags, label_queries, checkpoint_state,
        parsed_times, renamed_pages, spaces,
    )
}

_PAGES = "pages AS (SELECT * FROM api_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY version.number DESC) = 1)"
_LAST = f"""last AS (SELECT * REPLACE ({_strip('id')} AS id) FROM page_records WHERE run_id = (SELECT max(run_id) FROM page_records)
  QUALIFY row_number() OVER (PARTITION BY {_strip('id')} ORDER BY crawled_at DESC) = 1)"""
_ATT = f"""att AS (SELECT DISTINCT page_id, {_strip('attachment_id')} AS attachment_id, {_strip('filename')} AS filename, {_strip('media_type')} AS media_type, file_size, {_strip('file_id')} AS file_id
  FROM api_attachments QUALIFY row_number() OVER (PARTITION BY page_id, {_strip('attachment_id')} ORDER BY {_strip('filename')} DESC, {_strip('media_type')} DESC, file_size DESC NULLS LAST, {_strip('file_id')} DESC NULLS LAST) = 1)"""
_TARGETS = f"""{_PAGES}, found AS (
  SELECT page_id, unnest(list_concat(regexp_extract_all(adf, '"href"\\s*:\\s*"([^"]+)"', 1), regexp_extract_all(adf, '"url"\\s*:\\s*"([^"]+)"', 1))) AS target,
         generate_subscripts(list_concat(regexp_extract_all(adf, '"href"\\s*:\\s*"([^"]+)"', 1), regexp_extract_all(adf, '"url"\\s*:\\s*"([^"]+)"', 1)), 1) AS pos FROM pages),
edge_rows AS (
  SELECT page_id AS src, coalesce(TRY_CAST(nullif(regexp_extract(target, '[?&]pageId=([0-9]+)', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(target, '/spaces/[^/]+/pages/([0-9]+)', 1), '') AS BIGINT)) AS dst, pos
  FROM found WHERE target LIKE '/%' OR starts_with(lower(target), 'https://wiki.example.org/')),
edges AS (SELECT src, dst, min(pos) AS pos FROM edge_rows WHERE dst > 0 GROUP BY ALL)"""
_BFS = f"""{_TARGETS}, {_LAST}, live AS (SELECT CAST(l.id AS BIGINT) AS page_id, lower(trim(p.status)) IS DISTINCT FROM 'trashed' AS ok FROM last l LEFT JOIN pages p ON p.page_id = CAST(l.id AS BIGINT)),
graph AS (SELECT DISTINCT CAST(id AS BIGINT) AS src, TRY_CAST(unnest(outgoing_links) AS BIGINT) AS dst FROM last),
walks(page_id, depth) AS (
  SELECT DISTINCT CAST(s AS BIGINT), 0 FROM (SELECT unnest(seed_page_ids) AS s FROM run_state)
  UNION SELECT e.dst, w.depth + 1 FROM walks w JOIN live l ON l.page_id = w.page_id AND l.ok JOIN graph e ON e.src = w.page_id WHERE w.depth < {MAX_DEPTH}),
bfs AS (SELECT w.page_id, min(depth) AS depth, CASE WHEN bool_or(l.ok) THEN 'ok' ELSE 'deleted' END AS state FROM walks w LEFT JOIN live l USING (page_id) GROUP BY 1)"""
_SIG = """sigs AS (SELECT page_id, string_agg(part, ';' ORDER BY part) AS signature FROM (
  SELECT page_id, concat(coalesce(attachment_id, ''), '|', coalesce(filename, ''), '|', coalesce(media_type, ''), '|', coalesce(CAST(file_size AS VARCHAR), '')) AS part FROM att) GROUP BY 1)"""
_KINDS = f"""{_PAGES}, {_LAST}, {_ATT}, {_SIG},
kinds AS (SELECT coalesce(p.page_id, CAST(l.id AS BIGINT)) AS page_id, l.id AS prev_id, CASE
    WHEN p.page_id IS NULL OR lower(trim(p.status)) = 'trashed' THEN 'deleted'
    WHEN coalesce({_strip('p.title')}, '') = '' OR l.id IS NULL THEN 'dirty'
    WHEN p.version.number IS DISTINCT FROM l.version OR {_strip('p.title')} IS DISTINCT FROM l.title OR coalesce({_strip('l.attachment_signature')}, '') = ''
      OR coalesce(s.signature, 'none') <> l.attachment_signature THEN 'dirty' ELSE 'clean' END AS kind, coalesce(s.signature, 'none') AS signature
  FROM pages p FULL JOIN last l ON CAST(l.id AS BIGINT) = p.page_id LEFT JOIN sigs s ON s.page_id = p.page_id)"""
_USERS = f"""users AS (SELECT {_strip('account_id')} AS account_id, max(coalesce(nullif({_strip('display_name')}, ''), nullif({_strip('public_name')}, ''))) AS name FROM api_users GROUP BY 1)"""
_COMMENTS = f"""c AS (SELECT * REPLACE (nullif({_strip('parent_id')}, '') AS parent_id) FROM api_comments QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY updated_at DESC) = 1),
n AS (SELECT c.page_id, c.comment_id, c.created_at, p.comment_id AS up, row_number() OVER (PARTITION BY c.page_id, p.comment_id ORDER BY c.created_at NULLS LAST, c.comment_id) AS nth
      FROM c LEFT JOIN c p ON p.comment_id = c.parent_id AND p.page_id = c.page_id),
tree(page_id, comment_id, created_at, way, depth) AS (SELECT page_id, comment_id, created_at, [nth], 0 FROM n WHERE up IS NULL
  UNION ALL SELECT n.page_id, n.comment_id, n.created_at, list_append(t.way, n.nth), t.depth + 1 FROM tree t JOIN n ON n.up = t.comment_id AND n.page_id = t.page_id)"""
_STORED = r"regexp_replace(translate(filename, ' /\', '___'), '[\x00-\x1f\x7f]', '', 'g')"
_NAMED = f"concat(page_id, '_', coalesce(nullif(regexp_replace({_STORED}, '^[. ]+|[. ]+$', '', 'g'), ''), 'attachment'))"
_JSONQ = "concat('\"', replace(replace(coalesce({0}, ''), '\\', '\\\\'), '\"', '\\\"'), '\"')"


def _q(x: str) -> str:
    return _JSONQ.format(_strip(x))


def _stamp(x: str) -> str:
    return f"strftime({x} AT TIME ZONE 'UTC', '\"%Y-%m-%dT%H:%M:%SZ\"')"


SQL = {
    "link_edges": f"WITH {_TARGETS} SELECT src, dst FROM edges",
    "link_classes": f"WITH {_TARGETS} SELECT page_id, count(*) AS links, count(*) FILTER (target LIKE 'http%') AS external FROM found GROUP BY 1",
    "outgoing_links": f"WITH {_TARGETS} SELECT src, string_agg(dst, ',' ORDER BY pos) AS outgoing FROM edges GROUP BY 1",
    "incoming_links": f"""WITH {_LAST}, e AS (SELECT id AS src, unnest(outgoing_links) AS dst FROM last)
SELECT l.id, coalesce(string_agg(e.src, ',' ORDER BY e.src), '') AS incoming FROM last l LEFT JOIN e ON e.dst = l.id GROUP BY 1""",
    "bfs_depth": f"WITH RECURSIVE {_BFS} SELECT * FROM bfs",
    "depth_distribution": f"WITH RECURSIVE {_BFS} SELECT depth, count(*) AS pages FROM bfs GROUP BY 1",
    "crawl_stats": f"""WITH RECURSIVE {_BFS}, l AS (SELECT * FROM graph WHERE src IN (SELECT page_id FROM bfs WHERE state = 'ok') AND dst NOT IN (SELECT page_id FROM bfs WHERE state = 'deleted'))
SELECT (SELECT count(*) FROM bfs) AS total_pages, (SELECT count(*) FROM l) AS total_links, (SELECT count(DISTINCT dst) FROM l) AS unique_targets,
  (SELECT count(*) FROM found JOIN bfs USING (page_id) WHERE state = 'ok' AND target LIKE 'http%' AND target NOT LIKE 'https://wiki.example.org/%') AS external_skipped""",
    "prune_deleted_links": f"""WITH {_PAGES}, {_LAST}, e AS (SELECT id, unnest(outgoing_links) AS dst, generate_subscripts(outgoing_links, 1) AS pos FROM last),
kept AS (SELECT * FROM e WHERE dst NOT IN (SELECT CAST(page_id AS VARCHAR) FROM pages WHERE lower(trim(status)) = 'trashed'))
SELECT l.id, coalesce(string_agg(k.dst, ',' ORDER BY k.pos), '') AS outgoing FROM last l LEFT JOIN kept k USING (id) GROUP BY 1""",
    "prune_metadata": f"WITH {_PAGES}, {_LAST} SELECT id FROM last WHERE CAST(id AS BIGINT) IN (SELECT page_id FROM pages WHERE lower(trim(coalesce(status, ''))) <> 'trashed')",
    "dirty_clean_deleted": f"WITH {_KINDS} SELECT page_id, kind FROM kinds",
    "updates_summary": f"""WITH {_KINDS}, k AS (SELECT count(*) AS total, count(*) FILTER (kind = 'deleted') AS deleted, count(*) FILTER (kind = 'dirty') AS rerendered, count(*) FILTER (kind = 'clean') AS reused FROM kinds)
SELECT *, total - deleted AS reachable, CAST(CASE WHEN rerendered + reused = 0 THEN 0 ELSE round(reused * 100.0 / (rerendered + reused), 1) END AS DOUBLE) AS saved_percent FROM k""",
    "carry_over_records": f"""WITH {_KINDS} SELECT k.page_id, l.version, k.signature AS attachment_signature, coalesce(array_to_string(list_filter(l.outgoing_links, lambda x: regexp_full_match(x, '[0-9]+')), ','), '') AS outgoing, NULL::VARCHAR AS error
FROM kinds k JOIN last l ON l.id = k.prev_id WHERE kind = 'clean'""",
    "attachment_signature": f"WITH {_ATT}, {_SIG} SELECT * FROM sigs",
    "attachment_names": f"WITH {_ATT} SELECT page_id, attachment_id, {_NAMED} AS filename FROM att",
    "attachment_outcomes": f"""WITH {_ATT} SELECT file_size > {MAX_MB * 1024 * 1024} AS skipped, file_size <= {MAX_MB * 1024 * 1024} AND attachment_id <> '' AS stored, count(*) AS files FROM att GROUP BY ALL""",
    "artifact_reconcile": f"""WITH r AS (SELECT run_id, row_number() OVER (ORDER BY run_id DESC) AS k FROM (SELECT DISTINCT run_id FROM page_records)),
rows_ AS (SELECT k, local_path, attachments FROM page_records JOIN r USING (run_id) WHERE k <= 2 QUALIFY row_number() OVER (PARTITION BY k, {_strip('id')} ORDER BY crawled_at DESC) = 1),
files AS (SELECT k, trim(local_path) AS path FROM rows_ UNION SELECT k, trim(unnest(attachments)) FROM rows_)
SELECT path, CASE WHEN max(k) = 1 THEN 'added' WHEN min(k) = 2 THEN 'deleted' ELSE 'updated' END AS outcome FROM files WHERE path <> '' GROUP BY 1""",
    "seed_flags": f"WITH {_LAST} SELECT id, id IN (SELECT unnest(seed_page_ids) FROM run_state) AS is_seed FROM last",
    "seed_index": f"""WITH {_LAST}, s AS (SELECT seed_id, min(pos) AS pos FROM (SELECT unnest(seed_page_ids) AS seed_id, generate_subscripts(seed_page_ids, 1) - 1 AS pos FROM run_state) GROUP BY 1)
SELECT pos, CASE WHEN l.id IS NULL THEN '- Page ' || seed_id || ' (not present in current crawl output)'
  ELSE '- [' || {_strip('l.title')} || '](' || l.local_path || ')' || coalesce(' - source: <' || nullif({_strip('l.source_url')}, '') || '>', '') END AS line FROM s LEFT JOIN last l ON l.id = seed_id""",
    "author_names": f"""WITH {_PAGES}, {_USERS} SELECT page_id, a.name AS author, b.name AS editor FROM pages p LEFT JOIN users a ON a.account_id = {_strip('p.author_id')} LEFT JOIN users b ON b.account_id = {_strip('p.version.author_id')}""",
    "comment_order": f"""WITH RECURSIVE {_COMMENTS}
SELECT c.page_id, c.comment_id, row_number() OVER (PARTITION BY c.page_id ORDER BY t.way IS NULL, t.way, c.created_at, c.comment_id) AS position, t.depth FROM c LEFT JOIN tree t USING (comment_id)""",
    "rendered_user_cards": f"""WITH {_USERS} SELECT account_id, '# ' || name || chr(10) || chr(10) || '- `' || account_id || '`' || chr(10) || '- _**' || name || '**_' || chr(10) || chr(10)
  || '| id | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || account_id || ' | ' || name || ' |' AS markdown FROM users WHERE name IS NOT NULL""",
    "rendered_pages": f"""WITH RECURSIVE {_PAGES}, docs AS (SELECT CAST(page_id AS VARCHAR) AS k, adf FROM pages WHERE lower({_strip("coalesce(status, '')")}) <> 'trashed'),
{render_sql.markdown_ctes('docs')}
SELECT page_id, regexp_replace({render_sql.with_title('markdown', 'title')}, '\\]\\((/[^)\\s]+)\\)', ']({ORIGIN}\\1)', 'g') AS markdown FROM rendered JOIN pages ON CAST(page_id AS VARCHAR) = k""",
    "comments_markdown": f"""WITH RECURSIVE {_COMMENTS}, {_USERS}, docs AS (SELECT comment_id AS k, {_strip('body')} AS adf FROM c),
{render_sql.markdown_ctes('docs')},
placed AS (SELECT c.*, row_number() OVER (PARTITION BY c.page_id ORDER BY t.way IS NULL, t.way, c.created_at, c.comment_id) AS position FROM c LEFT JOIN tree t USING (comment_id)),
blocks AS (SELECT page_id, position, concat(coalesce(u.name, nullif({_strip('author_id')}, ''), 'Unknown Author'), chr(10), coalesce(strftime(created_at AT TIME ZONE 'UTC', '%-d %B %Y'), 'unknown'), chr(10),
  CASE WHEN coalesce({_strip('body')}, '') = '' THEN '(empty comment)' ELSE coalesce(nullif(r.markdown, ''), {_strip('body')}) END, chr(10), CASE WHEN updated_at > created_at THEN chr(10) || '(edited)' || chr(10) ELSE '' END) AS block
  FROM placed LEFT JOIN rendered r ON r.k = comment_id LEFT JOIN users u ON u.account_id = {_strip('author_id')})
SELECT page_id, {_strip("'## Comments' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY position)")} AS markdown FROM blocks GROUP BY page_id""",
    "attachment_links": f"""WITH {_LAST}, {_ATT}, m AS (SELECT id, storage_format_sample AS t FROM last WHERE contains(storage_format_sample, '](attachment://')),
good AS (SELECT CAST(page_id AS VARCHAR) AS id, filename AS name, 1 AS rank, 'attachments/' || {_NAMED} AS path, file_id FROM att WHERE attachment_id <> ''),
names AS (SELECT id, {_strip('name')} AS name, rank, path FROM good UNION ALL SELECT id, {_strip('file_id')}, 2, path FROM good WHERE file_id IS NOT NULL),
best AS (SELECT id, name, arg_min(path, {{'r': rank, 'p': path}}) AS path FROM names WHERE name <> '' GROUP BY ALL),
x AS (SELECT id, regexp_split_to_array(t, '\\]\\(attachment://[^)]+\\)') AS s, regexp_extract_all(t, '\\]\\(attachment://([^)]+)\\)', 1) AS u FROM m),
r AS (SELECT id, s, u, unnest(range(1, len(s) + 1)) AS i FROM x)
SELECT r.id, string_agg(s[i] || CASE WHEN i > len(u) THEN '' ELSE '](' || coalesce(b.path, 'attachment://' || u[i]) || ')' END, '' ORDER BY i) AS markdown
FROM r LEFT JOIN best b ON b.id = r.id AND i <= len(u) AND b.name = {_strip('u[i]')} GROUP BY 1""",
    "absolutize_links": f"""WITH {_TARGETS} SELECT page_id, string_agg('[' || target || '](' || CASE WHEN target LIKE '/%' THEN '{ORIGIN}' ELSE '' END || target || ')', chr(10) ORDER BY pos) AS markdown FROM found GROUP BY 1""",
    "label_enrich": f"""WITH {_TARGETS}, {_LAST}, u AS (SELECT page_id, pos, CASE WHEN target LIKE '/%' THEN '{ORIGIN}' ELSE '' END || target AS url FROM found),
t AS (SELECT CAST(id AS BIGINT) AS id, {_strip('title')} AS title FROM last WHERE {_strip('title')} <> '')
SELECT page_id, string_agg('[' || coalesce(t.title, url) || '](' || url || ')', chr(10) ORDER BY pos) AS markdown FROM u LEFT JOIN t ON t.id = TRY_CAST(regexp_extract(url, '/pages/([0-9]+)', 1) AS BIGINT) GROUP BY 1""",
    "front_matter": f"""WITH {_LAST} SELECT id, concat_ws(chr(10), '---', 'page_id: ' || {_q('id')}, 'title: ' || {_q('title')}, 'source_url: ' || {_q('source_url')}, 'canonical_url: ' || {_q('canonical_url')}, 'space_key: ' || {_q('space_key')},
  'is_seed: ' || CAST(id IN (SELECT unnest(seed_page_ids) FROM run_state) AS VARCHAR), 'crawled_at: ' || coalesce({_stamp('crawled_at')}, '"0001-01-01T00:00:00Z"'), 'created_at: ' || {_stamp('created_at')},
  CASE WHEN {_strip('created_by_name')} <> '' THEN 'created_by: ' || {_q('created_by_name')} END, 'last_modified_at: ' || {_stamp('last_modified_at')},
  CASE WHEN {_strip('last_modified_by_name')} <> '' THEN 'last_modified_by: ' || {_q('last_modified_by_name')} END, 'confluence_parent_id: ' || confluence_parent_id,
  CASE WHEN comment_count > 0 THEN 'comment_count: ' || comment_count END, CASE WHEN {_strip('comments_fetch_error')} <> '' THEN 'comments_fetch_error: ' || {_q('comments_fetch_error')} END,
  CASE WHEN len(attachments) > 0 THEN 'attachments:' || chr(10) || array_to_string(list_transform(list_sort(list_transform(attachments, lambda x: trim(x))), lambda x: '  - "' || x || '"'), chr(10)) END, '---' || chr(10)) AS front_matter FROM last""",
    "seed_resolve": f"""WITH {_LAST}, s AS (SELECT unnest([source_url, canonical_url, id]) AS seed FROM last)
SELECT DISTINCT seed, CASE WHEN regexp_full_match(seed, '[0-9]+') THEN CAST(seed AS BIGINT) ELSE coalesce(TRY_CAST(nullif(regexp_extract(seed, '[?&]pageId=([0-9]+)', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(seed, '/pages/([0-9]+)', 1), '') AS BIGINT)) END AS page_id,
  nullif(regexp_extract(seed, '/spaces/([^/?#]+)', 1), '') AS space_key FROM s WHERE seed IS NOT NULL""",
    "children_by_parent": f"WITH {_PAGES} SELECT CAST(trim(parent_id) AS BIGINT) AS parent_id, count(*) AS children, min(page_id) AS first_child, max(page_id) AS last_child FROM pages WHERE trim(parent_id) <> '' GROUP BY 1",
    "macro_flags": f"""WITH {_PAGES} SELECT page_id, coalesce(adf LIKE '%"extensionKey":"children"%' OR adf LIKE '%"extensionKey": "children"%', FALSE) AS children, coalesce(adf LIKE '%"contentbylabel"%', FALSE) AS by_label FROM pages""",
    "checkpoint_state": """WITH e AS (SELECT DISTINCT run_id, n FROM (SELECT run_id, 'c' AS n, last_completed AS c FROM run_state UNION ALL SELECT run_id, 's', last_successful FROM run_state)
  WHERE c IS NOT NULL AND (c.mode IS NOT NULL OR c.started IS NOT NULL OR c.completed IS NOT NULL) AND NOT coalesce(c.mode IN ('full', 'updates') AND c.completed >= c.started, FALSE))
SELECT run_id, bool_or(coalesce(last_successful.started = crawl_started_at, FALSE)) AS succeeded, (SELECT count(*) FROM e WHERE e.run_id = r.run_id) AS errors FROM run_state r GROUP BY 1""",
    "parsed_times": f"WITH {_PAGES} SELECT page_id, CASE WHEN created_at LIKE '%T%' THEN TRY_CAST(created_at AS TIMESTAMPTZ) END AS created_at FROM pages",
    "renamed_pages": f"""WITH r AS (SELECT run_id, row_number() OVER (ORDER BY run_id DESC) AS k FROM (SELECT DISTINCT run_id FROM page_records)),
t AS (SELECT k, {_strip('id')} AS id, {_strip('title')} AS title FROM page_records JOIN r USING (run_id) WHERE k <= 2 QUALIFY row_number() OVER (PARTITION BY k, {_strip('id')} ORDER BY crawled_at DESC) = 1)
SELECT a.id, a.title, b.title AS old_title FROM t a JOIN t b ON a.id = b.id AND a.k = 1 AND b.k = 2 WHERE a.title <> b.title""",
    "spaces": f"""WITH {_LAST} SELECT space_key, count(*) AS pages, count(*) FILTER ({_strip('fetch_error')} <> '') AS failed, count(*) FILTER ({_strip('attachment_signature')} <> '') AS signed FROM last GROUP BY 1""",
    "rewrite_stats": f"""WITH {_LAST}, m AS (SELECT id, unnest(regexp_extract_all(storage_format_sample, '\\[[^\\]]+\\]\\(([^)\\s]+)\\)', 1)) AS t FROM last),
x AS (SELECT m.id, l.id IS NOT NULL AS hit FROM m LEFT JOIN last l ON l.id = coalesce(nullif(regexp_extract(t, '[?&]pageId=([0-9]+)', 1), ''), regexp_extract(t, '/spaces/[^/]+/pages/([0-9]+)', 1)) AND trim(l.local_path) <> '')
SELECT (SELECT count(*) FROM last) AS pages_processed, count(DISTINCT id) FILTER (hit) AS pages_updated, count(*) AS links_seen, count(*) FILTER (hit) AS links_rewritten FROM x""",
    "label_queries": f"""WITH {_PAGES} SELECT query, count(*) AS uses FROM (
  SELECT unnest(regexp_extract_all(adf, '"cql"\\s*:\\s*\\{{\\s*"value"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"', 1)) AS q, replace(q, '\\"', '"') AS query FROM pages
  WHERE adf LIKE '%"contentbylabel"%' AND json_valid(adf)) GROUP BY 1""",
    "rewrite_links": f"""WITH {_LAST}, p AS (SELECT id, storage_format_sample AS t, '\\[[^\\]]+\\]\\(([^)\\s]+)\\)' AS pat FROM last),
x AS (SELECT id, t, regexp_split_to_array(t, pat) AS s, regexp_extract_all(t, pat, 0) AS l, regexp_extract_all(t, pat, 1) AS u FROM p),
r AS (SELECT id, s, l, u, unnest(range(1, len(s) + 1)) AS i FROM x),
n AS (SELECT r.id, i, s[i] AS piece, l[i] AS link, u[i] AS url, k.local_path || coalesce('#' || nullif(regexp_extract(u[i], '#(.+)$', 1), ''), '') AS target FROM r
  LEFT JOIN last k ON i <= len(l) AND trim(k.local_path) <> '' AND k.id = coalesce(nullif(regexp_extract(u[i], '[?&]pageId=([0-9]+)', 1), ''), regexp_extract(u[i], '/spaces/[^/]+/pages/([0-9]+)', 1))),
o AS (SELECT id, string_agg(piece || CASE WHEN link IS NULL THEN '' WHEN target <> url THEN left(link, len(link) - len(url) - 1) || target || ')' ELSE link END, '' ORDER BY i) AS markdown, count(*) FILTER (target <> url) AS n FROM n GROUP BY 1)
SELECT x.id, coalesce(o.markdown, x.t) AS markdown, coalesce(len(l), 0) AS links_seen, coalesce(n, 0) AS links_rewritten FROM x LEFT JOIN o ON o.id = x.id""",
}
