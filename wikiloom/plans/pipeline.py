"""A whole run, from tables to the exported knowledge base, in one of two modes.

``full`` renders every page that is reached; ``updates`` renders pages that are new or changed since the previous
records and carries the others over, with the links that they had. The order of text steps is fixed: render, title,
related pages, absolute links, labels, attachment links, comments, local links, front matter. With ``dry_run`` all
decisions are taken and nothing is rendered or written.

The current row of each page is chosen without its body. Links are extracted where bodies are read and only they are
shuffled; the bodies of pages that are rendered are read a second time. Text never passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.functions import urls
from wikiloom.functions.files import managed_path, page_filename
from wikiloom.functions.text import blank_to_null, strip_white
from wikiloom.operators import attachments as att, comments as com, incremental, links, records, render, snapshots, traversal
from wikiloom.session import materialize
from wikiloom.sources import store

EMPTY_LIST = "array<string>"


@dataclass
class Inputs:
    """Tables of the wiki, and what the run before left. ``related`` holds resolved queries: cql, pos, page_id; ``blobs``
    the files of attachments: attachment_id, content."""

    api_pages: DataFrame
    api_comments: DataFrame
    api_attachments: DataFrame
    api_users: DataFrame
    seeds: list[str]
    related: DataFrame | None = None
    previous: DataFrame | None = None
    blobs: DataFrame | None = None


@dataclass
class Result:
    """``metrics`` and the other dictionaries are what the report tells; ``outcomes`` the attachments of rendered pages."""

    reached: DataFrame
    edges: DataFrame
    classified: DataFrame
    records: DataFrame | None
    metrics: dict
    depths: dict[int, int]
    artifacts: DataFrame | None
    failed: int = 0
    links: dict | None = None
    rewritten: dict | None = None
    outcomes: DataFrame | None = None


def resolve_seeds(inputs: Inputs, pages: DataFrame) -> DataFrame:
    """(page_id, pos) of the configured seeds; raises if one cannot be resolved. Seeds are a handful of settings."""
    spark = pages.sparkSession
    given = spark.createDataFrame(list(enumerate(inputs.seeds)), "pos int, seed string")
    found = given.withColumn("page_id", urls.seed_page_id("seed"))
    missing = found.join(pages.select("page_id", F.lit(True).alias("there")), "page_id", "left").where("there IS NULL")
    if bad := [r.seed for r in missing.collect()]:
        raise ValueError(f"seeds cannot be resolved: {bad}")
    return found.groupBy("page_id").agg(F.min("pos").alias("pos"))


def sources_of_links(api_pages: DataFrame) -> DataFrame:
    """(page_id, targets, children, queries) of the current row of each page: its link targets, whether it lists its
    children, and its queries. Taken where bodies are read."""
    number = F.col("version.number").alias("number")
    rows = api_pages.select("page_id", number, links.targets_in("adf").alias("targets"), links.has_children_macro("adf").alias("children"), links.label_queries_column("adf").alias("queries"))
    return snapshots.latest_rows(rows, ["page_id"], [F.col("number")], ["targets", "children", "queries"])


def queries_of(linked: DataFrame) -> DataFrame:
    """(page_id, macro, cql) of the content-by-label macros of pages(page_id, queries)."""
    return linked.select("page_id", F.posexplode("queries").alias("macro", "cql"))


def all_edges(linked: DataFrame, parents: DataFrame, comments: DataFrame, related: DataFrame | None, host: str, follow_children: bool = False) -> DataFrame:
    """(src, dst, at): links of the body, then of comments, then children, then query hits; the first place counts.

    ``at`` orders the links of a page: origin, place within it, and for query hits the macro before the place of the hit,
    however many hits there are. linked(page_id, targets, children, queries), parents(page_id, parent_id),
    comments(page_id, targets).
    """
    at = lambda origin, place, hit=F.lit(0): F.struct(F.lit(origin).alias("origin"), place.cast("bigint").alias("place"), hit.cast("bigint").alias("hit")).alias("at")
    body = links.edges(linked, "page_id", "targets", host).select("src", "dst", at(1, F.col("pos")))
    talk = links.edges(comments, "page_id", "targets", host).select("src", "dst", at(2, F.col("pos")))
    kids = parents.select(F.col("page_id").alias("dst"), urls.whole_number(strip_white("parent_id")).alias("src"))
    listing = linked if follow_children else linked.where("children")
    kids = kids.join(listing.select(F.col("page_id").alias("src")), "src", "left_semi").select("src", "dst", at(3, F.lit(0), F.col("dst")))
    everything = body.unionByName(talk).unionByName(kids)
    if related is not None:
        hits = queries_of(linked).join(related.where("page_id > 0").select("cql", F.col("pos").alias("hit"), F.col("page_id").alias("dst")), "cql")
        everything = everything.unionByName(hits.select(F.col("page_id").alias("src"), "dst", at(4, F.col("macro"), F.col("hit"))))
    return everything.groupBy("src", "dst").agg(F.min("at").alias("at"))


def related_sections(linked: DataFrame, related: DataFrame, titles: DataFrame, base_url: str) -> DataFrame:
    """(page_id, related): a section for each query macro of pages(page_id, queries), its hits in order, titled where the
    title is known."""
    hits = queries_of(linked).join(related.select("cql", F.col("pos").alias("hit"), F.col("page_id").alias("dst")), "cql", "left")
    named = hits.join(titles.select(F.col("page_id").alias("dst"), F.col("title").alias("name")), "dst", "left")
    label = F.coalesce(blank_to_null("name"), F.col("dst").cast("string"))
    root = base_url.removesuffix("/wiki")
    line = F.concat(F.lit("- ["), label, F.lit(f"]({root}/wiki/pages/viewpage.action?pageId="), F.col("dst").cast("string"), F.lit(")\n"))
    lists = named.groupBy("page_id", "macro").agg(F.array_sort(F.collect_list(F.when(F.col("dst").isNotNull(), F.struct("hit", line.alias("line"))))).alias("x"))
    section = F.concat(F.lit("\n\n## Related pages\n\n"), F.array_join(F.transform("x", lambda e: e["line"]), ""))
    return lists.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("macro", section.alias("s")))), lambda e: e["s"]), "").alias("related"))


def render_pages(pages: DataFrame, ids: DataFrame, linked: DataFrame, inputs: Inputs, comments: DataFrame, titles: DataFrame, files: DataFrame | None, base_url: str, origin: str) -> DataFrame:
    """(page_id, markdown, error) of the pages given, up to and with their comments; ``ids`` are theirs, materialized.
    Without ``files`` links to attachments stay as they are."""
    text = pages.select("page_id", "title", render.rendered(F.col("adf")).alias("markdown"))
    text = text.withColumn("error", F.when(F.col("markdown").isNull(), "convert failed"))
    body = text.select("page_id", render.with_title(F.col("markdown"), F.coalesce("title", F.lit(""))).alias("markdown"))
    if inputs.related is not None:
        sections = related_sections(linked.join(ids.select("page_id"), "page_id", "left_semi"), inputs.related, titles, base_url)
        body = body.join(sections, "page_id", "left").select("page_id", F.concat("markdown", F.coalesce("related", F.lit(""))).alias("markdown"))
    body = body.select("page_id", links.absolutize("markdown", origin).alias("markdown"))
    body = links.enrich_labels(body, "page_id", "markdown", titles)
    if files is not None:
        body = links.rewrite_attachments(body, "page_id", "markdown", files)
    ordered = com.ordered_comments(comments.drop("targets"))
    named = com.with_author(ordered, com.users(inputs.api_users), "author_id", "author")
    texts = com.current_comments(snapshots.only_ids(inputs.api_comments, ids, "page_id"), text=com.comment_text("body"))
    talk = com.comments_markdown(com.comment_blocks(named, texts)).withColumnRenamed("markdown", "talk")
    joined = body.join(talk, "page_id", "left").join(text.select("page_id", "error"), "page_id")
    tail = F.when(F.col("talk").isNotNull(), F.concat(F.lit("\n\n"), "talk")).otherwise("")
    return joined.select("page_id", F.concat(F.rtrim("markdown", F.lit("\n")), tail, F.lit("\n")).alias("markdown"), "error")


def run(
    inputs: Inputs,
    base_url: str,
    now: datetime,
    mode: str = "full",
    max_depth: int = 3,
    max_attachment_mb: int = 0,
    dry_run: bool = False,
    handler: traversal.Handler | None = None,
    download_attachments: bool = True,
    max_queue: int | None = None,
    follow_children: bool = False,
) -> Result:
    """Traverse, classify, render and rebuild; see the module. ``previous`` is needed for updates to have any effect.

    Without ``download_attachments`` pages list no attachments, links to them stay, and signatures neither make a page
    dirty nor change. A level of more than ``max_queue`` pages ends the run.
    """
    if mode not in records.MODES:
        raise ValueError(f"mode must be one of {records.MODES}")
    origin = "/".join(base_url.split("/")[:3])
    host = origin.split("//")[-1]
    rows = inputs.api_pages.where("page_id IS NOT NULL")
    plain = [c for c in rows.columns if c not in ("page_id", "adf")]
    pages = materialize(snapshots.latest_rows(rows.select("page_id", *plain), ["page_id"], [F.col("version.number")], plain))
    comments = materialize(com.current_comments(inputs.api_comments, targets=links.targets_in("body")))
    files = att.clean_attachments(inputs.api_attachments)
    seeds = resolve_seeds(inputs, pages)
    state = pages.select("page_id", "status", strip_white("title").alias("title"), F.col("version.number").alias("version"))
    if download_attachments:
        state = state.join(att.signatures(files), "page_id", "left").withColumn("signature", F.coalesce("signature", F.lit("none")))
    else:
        state = state.withColumn("signature", F.lit(""))
    state = state.withColumns({"found": F.lit(True), "error": F.lit(None).cast("string")})
    updating = mode == "updates" and inputs.previous is not None
    if updating:
        prev = inputs.previous.select(F.col("id").try_cast("bigint").alias("page_id"), "title", "version", F.col("attachment_signature").alias("signature"))
        kinds = incremental.classify_pages(state, prev, download_attachments)
    else:
        gone = F.coalesce(F.lower(strip_white("status")) == "trashed", F.lit(False))
        kinds = state.withColumn("kind", F.when(gone, "deleted").otherwise("dirty")).withColumn("p_title", F.lit(None).cast("string"))
    kinds = materialize(kinds.select("page_id", "kind", "title", "p_title", "version", "signature", "error"))
    linked = materialize(sources_of_links(rows))
    edges = all_edges(linked, pages.select("page_id", "parent_id"), comments, inputs.related, host, follow_children)
    if updating:
        edges = _with_kept_links(edges, kinds, inputs.previous)
    edges = materialize(edges)
    reached = materialize(traversal.traverse(seeds, edges, max_depth, handler or traversal.page_handler(pages), max_queue))
    known = reached.select("page_id", "depth", "state").join(kinds, "page_id", "left")
    kind = F.when(F.col("state") == "deleted", "deleted").otherwise(F.col("kind"))
    # A page that is gone is told by the title that it had.
    classified = known.select("page_id", "depth", kind.alias("kind"), F.when(kind == "deleted", F.coalesce("title", "p_title")).otherwise(F.col("title")).alias("title"), "version", "signature", "error")
    classified = materialize(classified)
    metrics = records.run_metrics(classified).first().asDict()
    depths = {r.depth: r.pages for r in traversal.depth_distribution(reached).collect()}
    external = links.external_counts(linked.join(kinds.where("kind = 'dirty'").select("page_id"), "page_id", "left_semi"), "page_id", "targets", host)
    told = traversal.crawl_stats(reached, edges.select("src", "dst"), external.select("page_id", "external")).first().asDict()
    if dry_run:
        return Result(reached, edges, classified, None, metrics, depths, None, links=told)
    live = classified.where("kind <> 'deleted'").select(F.col("page_id").alias("src"))
    gone = materialize(classified.where("kind = 'deleted'").select(F.col("page_id").alias("dst")))
    out = edges.join(live, "src", "left_semi").join(gone, "dst", "left_anti")
    outgoing = out.groupBy("src").agg(links.ordered_ids(F.col("dst"), F.col("at")).alias("outgoing_links"))
    ids = materialize(classified.where("kind = 'dirty'").select("page_id", "depth", "signature"))
    # Bodies are read again for the pages that are rendered, and only theirs are shuffled.
    bodies = snapshots.only_ids(rows, ids, "page_id").select("page_id", F.col("version.number").alias("number"), "adf")
    dirty = pages.join(ids, "page_id").join(snapshots.latest_rows(bodies, ["page_id"], [F.col("number")], ["adf"]), "page_id")
    results = att.outcomes(files.join(ids.select("page_id"), "page_id", "left_semi"), max_attachment_mb) if download_attachments else None
    spoken = comments.join(ids.select("page_id"), "page_id", "left_semi")
    text = materialize(render_pages(dirty, ids, linked, inputs, spoken, pages.select("page_id", "title"), results, base_url, origin))
    fresh = materialize(_fresh_records(pages.join(ids, "page_id"), text, inputs, spoken, results, outgoing, now))
    merged = _merge(fresh, classified, inputs, gone.select("dst"))
    final, rewritten = materialize_rewritten(merged)
    old = inputs.previous if updating else final.limit(0)
    metrics |= records.run_counts(classified, final, results, inputs.previous)
    failed = text.where("error IS NOT NULL").count()
    return Result(reached, out, classified, final, metrics, depths, records.reconcile(old, final), failed, told, rewritten, results)


def materialize_rewritten(merged: DataFrame) -> tuple[DataFrame, dict]:
    """Records with links to local files and with incoming links, and how many links were rewritten."""
    paths = merged.select(F.col("id").try_cast("bigint").alias("page_id"), managed_path("local_path").alias("local_path")).where("local_path IS NOT NULL")
    local = materialize(links.rewrite(merged.select("id", "storage_format_sample"), "id", "storage_format_sample", paths))
    linked = links.incoming(merged.select("id", "outgoing_links"), "id", "outgoing_links").withColumnRenamed("incoming", "incoming_links")
    final = merged.drop("storage_format_sample", "incoming_links").join(local.select("id", F.col("markdown").alias("storage_format_sample")), "id").join(linked, "id")
    return materialize(final), links.rewrite_stats(local).first().asDict()


def _with_kept_links(edges: DataFrame, kinds: DataFrame, previous: DataFrame) -> DataFrame:
    """Edges where clean pages have the links of their previous records."""
    clean = kinds.where("kind = 'clean'").select(F.col("page_id").alias("src"))
    before = previous.select(F.col("id").try_cast("bigint").alias("src"), F.posexplode(links.parse_ids("outgoing_links")).alias("place", "dst"))
    at = F.struct(F.lit(1).alias("origin"), F.col("place").cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("hit")).alias("at")
    return edges.join(clean, "src", "left_anti").unionByName(before.join(clean, "src", "left_semi").select("src", "dst", at))


def _page_path(title: str, key: Column | str) -> Column:
    @F.pandas_udf("string")
    def path(title: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([page_filename(t or "", k) for t, k in zip(title, key, strict=True)], dtype=object)

    return path(title, key)


def _fresh_records(dirty: DataFrame, text: DataFrame, inputs: Inputs, comments: DataFrame, results: DataFrame | None, outgoing: DataFrame, now: datetime) -> DataFrame:
    """Records of rendered pages; a page whose text is broken is left out here and keeps its previous record."""
    names = com.users(inputs.api_users)
    counts = comments.groupBy("page_id").agg(F.count("*").cast("int").alias("comment_count"))
    rows = dirty.join(text.where("error IS NULL"), "page_id").withColumns({"created_by_id": strip_white("author_id"), "last_modified_by_id": strip_white("version.author_id")})
    rows = com.with_author(com.with_author(rows, names, "created_by_id", "created_by_name"), names, "last_modified_by_id", "last_modified_by_name")
    empty = F.array().cast(EMPTY_LIST)
    if results is None:
        rows = rows.withColumn("attachments", empty)
    else:
        stored = results.where("error IS NULL").groupBy("page_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("attachments/"), "filename"))).alias("attachments"))
        rows = rows.join(stored, "page_id", "left")
    rows = rows.join(counts, "page_id", "left").join(outgoing.withColumnRenamed("src", "page_id"), "page_id", "left")
    return rows.select(
        F.col("page_id").cast("string").alias("id"),
        "title",
        _page_path("title", F.col("page_id").cast("string")).alias("local_path"),
        F.col("version.number").alias("version"),
        F.lit(now).alias("crawled_at"),
        F.coalesce("comment_count", F.lit(0)).alias("comment_count"),
        F.lit(None).cast("string").alias("comments_fetch_error"),
        F.col("webui").alias("source_url"),
        F.col("webui").alias("canonical_url"),
        "space_key",
        "depth",
        F.coalesce("outgoing_links", empty).alias("outgoing_links"),
        empty.alias("incoming_links"),
        F.coalesce("attachments", empty).alias("attachments"),
        F.col("signature").alias("attachment_signature"),
        F.col("markdown").alias("storage_format_sample"),
        urls.parse_time("created_at").alias("created_at"),
        urls.parse_time("version.created_at").alias("last_modified_at"),
        "created_by_id",
        "created_by_name",
        "last_modified_by_id",
        "last_modified_by_name",
        urls.whole_number(strip_white("parent_id")).alias("confluence_parent_id"),
    )


def _merge(fresh: DataFrame, classified: DataFrame, inputs: Inputs, deleted: DataFrame) -> DataFrame:
    """Fresh records; carried-over ones of clean pages, with the newer signature and without links to deleted pages; and
    the previous ones of pages that failed. Deleted and unreached pages are left out."""
    if inputs.previous is None:
        return fresh
    columns = fresh.columns
    prev = inputs.previous.select(*[F.col(c).cast(fresh.schema[c].dataType).alias(c) if c in inputs.previous.columns else F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in columns])
    clean = records.carry_over(classified.select("page_id", "kind", "depth", "signature"), prev).where("error IS NULL")
    failed = classified.where("kind = 'dirty'").select(F.col("page_id").cast("string").alias("id"), F.col("depth").alias("new_depth"))
    failed = prev.join(failed, "id").join(fresh.select("id"), "id", "left_anti").withColumn("depth", F.col("new_depth"))
    kept = clean.select(*columns).unionByName(failed.select(*columns))
    named = F.when(F.coalesce(strip_white("local_path"), F.lit("")) == "", _page_path("title", "id")).otherwise(F.col("local_path"))
    kept = materialize(kept.withColumn("local_path", named))
    pruned = links.without_deleted(kept.select("id", "outgoing_links"), "id", "outgoing_links", deleted)
    kept = kept.drop("outgoing_links").join(pruned.withColumnRenamed("outgoing", "outgoing_links"), "id")
    return materialize(fresh.unionByName(kept.select(*columns)))


def export(result: Result, inputs: Inputs, folder: str, run_id: int, advance: Callable[[], dict] | None = None, clear: bool = False) -> dict[str, int]:
    """Write pages with front matter, attachments, metadata, snapshot and start page, remove stale files; counts of files
    by outcome, and of attachments of kept pages that are not there.

    ``folder`` is shared by all executors; with ``clear`` it is emptied first. A page whose text and path are those of its
    previous record is written only if its file is missing. Snapshot and checkpoints become current together, after all
    files are there: ``advance`` gives the checkpoints then. A run that fails before leaves those of the run before.
    """
    if clear:
        store.clear_folder(folder)
    spark = result.records.sparkSession
    seeds = spark.createDataFrame(list(enumerate(inputs.seeds)), "pos int, seed string").select("pos", urls.seed_page_id("seed").cast("string").alias("seed_id"))
    heads = records.front_matter(records.seed_flags(result.records, seeds))
    body = result.records.join(heads, "id").select(
        "id", "local_path", "storage_format_sample", F.concat("front_matter", F.lit("\n"), records.strip_front_matter("storage_format_sample")).alias("text")
    )
    same = F.lit(False)
    if inputs.previous is not None:
        before = inputs.previous.select("id", F.col("local_path").alias("old_path"), F.col("storage_format_sample").alias("old_text"))
        body = body.join(before, "id", "left")
        same = F.coalesce((F.col("old_path") == F.col("local_path")) & (F.col("old_text") == F.col("storage_format_sample")), F.lit(False))
    store.write_pages(body.select("local_path", "text", same.alias("keep")), folder)
    if result.outcomes is not None and inputs.blobs is not None:
        att.copy_blobs(result.outcomes, inputs.blobs, f"{folder}/attachments")
    store.write_metadata(result.records, f"{folder}/metadata.json")
    snapshot = store.write_snapshot(result.records, folder, run_id)
    store.remove_files(result.artifacts.where("outcome = 'deleted'"), folder)
    counts = {r.outcome: r["count"] for r in result.artifacts.groupBy("outcome").count().collect()}
    kept = result.classified.where("kind = 'clean'").select(F.col("page_id").cast("string").alias("id"))
    kept = result.records.join(kept, "id", "left_semi").select(F.explode("attachments").alias("path"))
    counts["missing"] = store.missing_files(kept, folder).count()
    checkpoints = advance() if advance else store.current(folder).get("checkpoints", {})
    store.commit(folder, run_id, snapshot, checkpoints)
    lines = [r.line for r in records.index_lines(result.records, seeds).orderBy("pos").collect()]
    store.write_text(folder, "index.md", records.index_page(lines, *(records.checkpoint_text(checkpoints.get(k)) for k in ("successful", "completed"))))
    return counts
