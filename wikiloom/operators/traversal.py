"""Depth-bounded breadth-first traversal of a link graph.

One job per level: the frontier joins its edges, and what was visited before is removed by an anti-join. Each level is
written to the shared checkpoint folder, so lineage stays flat and a lost executor costs one level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from wikiloom.session import materialize

Handler = Callable[[DataFrame], DataFrame]


class FrontierTooLarge(RuntimeError):
    """A level has more pages than the traversal was allowed to queue; ``sample`` has the first 20 of them."""

    def __init__(self, depth: int, size: int, sample: list[int]):
        self.depth, self.size, self.sample = depth, size, sample
        super().__init__(f"crawl queue saturated: {size} pages at depth {depth}, among them {sample}")


def page_handler(pages: DataFrame) -> Handler:
    """Join the frontier to its pages: state is ``deleted`` where a page is missing or trashed, else ``ok``."""
    known = pages.select("page_id", F.col("status"), F.lit(True).alias("there"))

    def handle(frontier: DataFrame) -> DataFrame:
        gone = F.col("there").isNull() | F.coalesce(F.lower(F.trim("status")) == "trashed", F.lit(False))
        return frontier.join(known, "page_id", "left").select("page_id", "depth", F.when(gone, "deleted").otherwise("ok").alias("state"))

    return handle


def traverse(seeds: DataFrame, edges: DataFrame, max_depth: int, handler: Handler, max_frontier: int | None = None) -> DataFrame:
    """(page_id, depth, state) of every page reached from seeds(page_id) over edges(src, dst).

    depth is the least number of links from a seed, seeds being 0; pages in a state other than ``ok`` are reported and
    not expanded; no page is looked at twice. ``handler`` adds the state to a frontier (page_id, depth). With
    ``max_frontier`` a larger level raises :class:`FrontierTooLarge` with a sample of 20 pages. NULL seeds are ignored;
    no seeds give no rows.
    """
    step = seeds.select("page_id").where("page_id IS NOT NULL").distinct().withColumn("depth", F.lit(0))
    level = materialize(handler(step))
    reached = level
    for depth in range(1, max_depth + 1):
        grown = level.where("state = 'ok'").join(edges, F.col("page_id") == F.col("src")).select(F.col("dst").alias("page_id")).distinct()
        fresh = grown.join(reached.select("page_id"), "page_id", "left_anti").withColumn("depth", F.lit(depth))
        level = materialize(handler(fresh))
        size = level.count()
        if not size:
            break
        if max_frontier is not None and size > max_frontier:
            sample = [r[0] for r in level.orderBy("page_id").select("page_id").limit(20).collect()]
            raise FrontierTooLarge(depth, size, sample)
        reached = reached.unionByName(level)
    return reached


def crawl_stats(reached: DataFrame, edges: DataFrame, external: DataFrame) -> DataFrame:
    """One row: pages, links of the pages that were expanded, their distinct targets, external links skipped.

    Links to deleted pages do not count; deleted pages count as pages.
    """
    live, gone = reached.where("state = 'ok'").select(F.col("page_id").alias("src")), reached.where("state = 'deleted'").select(F.col("page_id").alias("dst"))
    links = edges.join(live, "src", "left_semi").join(gone, "dst", "left_anti")
    skipped = external.join(live.withColumnRenamed("src", "page_id"), "page_id", "left_semi")
    pages = reached.agg(F.count("*").alias("total_pages"))
    sums = links.agg(F.count("*").alias("total_links"), F.count_distinct("dst").alias("unique_targets"))
    out = skipped.agg(F.coalesce(F.sum("external"), F.lit(0)).alias("external_skipped"))
    rows = pages.unionByName(sums, allowMissingColumns=True).unionByName(out, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def depth_distribution(reached: DataFrame) -> DataFrame:
    return reached.groupBy("depth").agg(F.count("*").alias("pages"))
