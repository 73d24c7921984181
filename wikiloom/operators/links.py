"""Links between pages: extraction from document text, edges, adjacency lists, rewriting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.functions import urls
from wikiloom.functions.text import col, strip_white
from wikiloom.operators.nested import parse_json

_HREF, _URL = '"href"\\s*:\\s*"([^"]+)"', '"url"\\s*:\\s*"([^"]+)"'
MARKDOWN_LINK = r"\[[^\]]+\]\(([^)\s]+)\)"


def targets_in(document: Column | str) -> Column:
    """array<string> of the links in a raw document text: all ``href`` first, then all ``url`` (JVM-side)."""
    d = col(document)
    return F.concat(F.regexp_extract_all(d, F.lit(_HREF), F.lit(1)), F.regexp_extract_all(d, F.lit(_URL), F.lit(1)))


def link_targets(pages: DataFrame, key: str, document: str) -> DataFrame:
    """(key, pos, target) of every link; ``document`` is a raw document text, or what :func:`targets_in` found in it."""
    found = targets_in(document) if pages.schema[document].dataType.simpleString() == "string" else F.col(document)
    return pages.select(key, F.posexplode(found).alias("pos", "target")).withColumn("target", strip_white("target"))


def classified_targets(pages: DataFrame, key: str, document: str, allowed_host: str) -> DataFrame:
    """(key, pos, target, class, dst): internal targets have the page they point to, or 0."""
    seen = link_targets(pages, key, document).withColumn("class", urls.crawl_target("target", allowed_host))
    return seen.withColumn("dst", F.when(F.col("class") == "internal", urls.page_id("target")))


def edges(pages: DataFrame, key: str, document: str, allowed_host: str) -> DataFrame:
    """(src, dst, pos): distinct edges in the order of their first link."""
    found = classified_targets(pages, key, document, allowed_host).where("dst > 0")
    return found.groupBy(F.col(key).alias("src"), "dst").agg(F.min("pos").alias("pos"))


def external_counts(pages: DataFrame, key: str, document: str, allowed_host: str) -> DataFrame:
    """(key, links, external): every link counts, repeated ones too."""
    found = classified_targets(pages, key, document, allowed_host)
    return found.groupBy(key).agg(F.count("*").alias("links"), F.count_if(F.col("class") == "external").alias("external"))


def ordered_ids(items: Column, order: Column) -> Column:
    """Ids as text in the order of another column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, items.cast("string").alias("id")))), lambda x: x["id"])


def outgoing(edge_rows: DataFrame) -> DataFrame:
    """(src, outgoing): ids in link order."""
    return edge_rows.groupBy("src").agg(ordered_ids(F.col("dst"), F.col("pos").alias("pos")).alias("outgoing"))


def incoming(pages: DataFrame, key: str, outgoing_links: str) -> DataFrame:
    """(key, incoming): for each page the pages that link to it, in string order.

    Repeated links count each time, self-links are kept, links to pages that are not there are left out, and pages
    without links to them have an empty list.
    """
    known = pages.select(F.col(key).cast("string").alias("dst"))
    links = pages.select(F.col(key).cast("string").alias("src"), F.explode(outgoing_links).alias("dst"))
    lists = links.join(known, "dst", "left_semi").groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("incoming"))
    return known.join(lists, "dst", "left").select(F.col("dst").alias(key), F.coalesce("incoming", F.array().cast("array<string>")).alias("incoming"))


def without_deleted(pages: DataFrame, key: str, outgoing_links: str, deleted: DataFrame) -> DataFrame:
    """(key, outgoing): links to deleted pages are left out, all others kept with their order and repeats; NULL is none."""
    links = pages.select(key, F.posexplode(outgoing_links).alias("pos", "dst"))
    kept = links.join(deleted.select(F.col(deleted.columns[0]).cast("string").alias("dst")).distinct(), "dst", "left_anti")
    lists = kept.groupBy(key).agg(ordered_ids(F.col("dst"), F.col("pos")).alias("outgoing"))
    return pages.select(key).join(lists, key, "left").select(key, F.coalesce("outgoing", F.array().cast("array<string>")).alias("outgoing"))


def parse_ids(ids: Column | str) -> Column:
    """Positive whole numbers of a list of texts, each once, in order."""
    return F.array_distinct(F.filter(F.transform(col(ids), lambda x: urls.whole_number(strip_white(x))), lambda x: x > 0))


def has_children_macro(document: Column | str) -> Column:
    d = col(document)
    return d.contains('"extensionKey":"children"') | d.contains('"extensionKey": "children"')


def label_queries(document: str | None) -> list[str]:
    """Queries of the content-by-label macros of a document, in document order; none for broken ones."""
    if not document or '"contentbylabel"' not in document:
        return []
    out, todo = [], [parse_json(document)]
    while todo:
        node = todo.pop()
        if not isinstance(node, dict):
            continue
        attrs = node.get("attrs")
        if node.get("type") == "extension" and isinstance(attrs, dict) and attrs.get("extensionKey") == "contentbylabel":
            at = attrs
            for step in ("parameters", "macroParams", "cql", "value"):
                at = at.get(step) if isinstance(at, dict) else None
            if isinstance(at, str) and at:
                out.append(at)
        content = node.get("content")
        todo += reversed(content) if isinstance(content, list) else []
    return out


def label_queries_column(document: Column | str) -> Column:
    """array<string> of :func:`label_queries`; only documents with the macro leave the JVM."""
    d = col(document)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(label_queries)

    return run(F.when(d.contains('"contentbylabel"'), d))


def absolutize(markdown: Column | str, origin: str) -> Column:
    """Root-relative link targets with scheme and host."""
    return F.regexp_replace(col(markdown), r"\]\((/[^)\s]+)\)", f"]({origin}$1)")


def markdown_links(pages: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, pos, target, dst) of every Markdown link, images included."""
    found = F.regexp_extract_all(markdown, F.lit(MARKDOWN_LINK), F.lit(1))
    links = pages.select(key, F.posexplode(found).alias("pos", "target"))
    return links.withColumn("dst", urls.page_id("target"))


def rewrite(pages: DataFrame, key: str, markdown: str, paths: DataFrame) -> DataFrame:
    """(key, markdown, links_seen, links_rewritten): links to known pages point to their local path.

    ``paths`` has (page_id, local_path); links meet it in a join on the id, so neither side has to fit into memory, and
    only each page's own replacements go back to it. Fragments are kept; links that would not change are not counted.
    """
    links = markdown_links(pages, key, markdown)
    fragment = F.coalesce(F.concat(F.lit("#"), F.nullif(F.regexp_extract("target", "#(.+)$", 1), F.lit(""))), F.lit(""))
    hits = links.where("dst > 0").join(paths.select(F.col("page_id").alias("dst"), "local_path"), "dst", "left")
    hits = hits.select(key, "pos", F.when(F.concat("local_path", fragment) != F.col("target"), F.concat("local_path", fragment)).alias("new")).where("new IS NOT NULL")
    lists = hits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("new"))
    seen = F.size(F.regexp_extract_all(markdown, F.lit(MARKDOWN_LINK), F.lit(1)))
    joined = pages.select(key, F.col(markdown).alias("markdown"), F.coalesce(seen, F.lit(0)).alias("links_seen")).join(lists, key, "left")
    pattern = re.compile(r"\[[^\]]+\]\(([^)\t\n\f\r ]+)\)")

    @F.pandas_udf("string")
    def put(text: pd.Series, new: pd.Series) -> pd.Series:
        def one(t, m):
            if t is None or not m:
                return t
            m = dict(m)
            n = iter(range(len(t)))

            def swap(hit):
                at = m.get(next(n))
                return hit[0] if at is None else hit[0][: hit.start(1) - hit.start()] + at + ")"

            return pattern.sub(swap, t)

        return pd.Series([one(t, m) for t, m in zip(text, new, strict=True)], dtype=object)

    count = F.when(F.col("new").isNull(), 0).otherwise(F.size("new"))
    changed = joined.where("new IS NOT NULL").select(key, put("markdown", "new").alias("markdown"), "links_seen", count.alias("links_rewritten"))
    same = joined.where("new IS NULL").select(key, "markdown", "links_seen", F.lit(0).alias("links_rewritten"))
    return changed.unionByName(same)


def rewrite_stats(rewritten: DataFrame) -> DataFrame:
    """One row: pages processed and updated, links seen and rewritten."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rewritten.agg(F.count("*").alias("pages_processed"), F.count_if(F.col("links_rewritten") > 0).alias("pages_updated"), total("links_seen"), total("links_rewritten"))


def enrich_labels(lines: DataFrame, key: str, markdown: str, titles: DataFrame) -> DataFrame:
    """(key, markdown): links whose label is their own URL get the title of the page they point to.

    ``titles`` has (page_id, title). Texts without such links take no part in the join.
    """
    pattern = r"\[(https?://[^\]\s]+)\]\((https?://[^)\s]+)\)"
    m = F.col(markdown)
    found = F.arrays_zip(F.regexp_extract_all(m, F.lit(pattern), F.lit(1)).alias("label"), F.regexp_extract_all(m, F.lit(pattern), F.lit(2)).alias("target"))
    pairs = lines.select(key, F.explode(F.array_distinct(found)).alias("x")).select(key, "x.label", "x.target").where("label = target")
    pairs = pairs.withColumn("_dst", urls.whole_number(F.nullif(F.regexp_extract("target", "/pages/([0-9]+)", 1), F.lit(""))))
    named = pairs.join(titles.select(F.col("page_id").alias("_dst"), strip_white("title").alias("title")).where("title <> ''"), "_dst")
    lists = named.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("target", "title"))).alias("swaps"))
    old = lambda s: F.concat(F.lit("["), s["target"], F.lit("]("), s["target"], F.lit(")"))
    new = lambda s: F.concat(F.lit("["), s["title"], F.lit("]("), s["target"], F.lit(")"))
    text = F.when(F.col("swaps").isNull(), m).otherwise(F.aggregate("swaps", m, lambda t, s: F.replace(t, old(s), new(s))))
    return lines.join(lists, key, "left").select(key, text.alias("markdown"))


def rewrite_attachments(pages: DataFrame, key: str, markdown: str, results: DataFrame) -> DataFrame:
    """(key, markdown): ``attachment://`` links point to the stored file, found by original name first, then by file id.

    ``results`` has (key, filename, original_name, file_id, error); failed ones are ignored, unknown targets stay.
    """
    good = results.where("error IS NULL AND coalesce(filename, '') <> ''")
    path = F.concat(F.lit("attachments/"), F.col("filename"))
    names = good.select(key, F.col("original_name").alias("name"), F.lit(1).alias("rank"), path.alias("path")).unionByName(
        good.select(key, F.col("file_id").alias("name"), F.lit(2).alias("rank"), path.alias("path"))
    )
    best = names.where(strip_white("name") != "").groupBy(key, "name").agg(F.min(F.struct("rank", "path"))["path"].alias("path"))
    used = pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(markdown, F.lit(r"\]\(attachment://([^)]+)\)"), F.lit(1)))).alias("raw"))
    hits = used.withColumn("name", strip_white("raw")).join(best, [key, "name"])
    lists = hits.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("raw", "path"))).alias("swaps"))
    swap = lambda t, s: F.replace(t, F.concat(F.lit("](attachment://"), s["raw"], F.lit(")")), F.concat(F.lit("]("), s["path"], F.lit(")")))
    m = F.col(markdown)
    return pages.join(lists, key, "left").select(key, F.when(F.col("swaps").isNull(), m).otherwise(F.aggregate("swaps", m, swap)).alias("markdown"))
