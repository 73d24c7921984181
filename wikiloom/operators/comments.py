"""Comments: states, authors, display order, Markdown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.functions.text import blank_to_null, col, strip_white
from wikiloom.operators.hierarchy import resolve_hierarchy
from wikiloom.operators.ranking import rank_within
from wikiloom.operators.render import extensions, registered, try_render
from wikiloom.operators.snapshots import LOCATOR, current_rows, latest_rows


def current_comments(api_comments: DataFrame, **made: Column) -> DataFrame:
    """The row of each comment that was updated last, ids stripped, with what ``made`` takes from its body (where it is
    read); bodies themselves are not part of it. Where rows know their place only that is compared."""
    plain = {"comment_id": blank_to_null("comment_id"), "page_id": F.col("page_id"), "parent_id": blank_to_null("parent_id"), "author_id": strip_white("author_id"), "created_at": F.col("created_at"), "updated_at": F.col("updated_at")}
    columns = {**plain, **made}
    located = set(LOCATOR) <= set(api_comments.columns)
    rows = api_comments.select(*[c.alias(n) for n, c in columns.items()], *(LOCATOR if located else ())).where("comment_id IS NOT NULL")
    if located:
        keys = api_comments.select(blank_to_null("comment_id").alias("comment_id"), "updated_at", *LOCATOR).where("comment_id IS NOT NULL")
        return current_rows(keys, ["comment_id"], [F.col("updated_at")], rows)
    return latest_rows(rows, ["comment_id"], [F.col("updated_at")], [c for c in columns if c != "comment_id"])


def users(api_users: DataFrame) -> DataFrame:
    """(account_id, name): display name, else public name; accounts without either have none."""
    rows = api_users.select(strip_white("account_id").alias("account_id"), F.coalesce(blank_to_null("display_name"), blank_to_null("public_name")).alias("name"))
    return rows.where("account_id <> ''").groupBy("account_id").agg(F.max("name").alias("name"))


def with_author(df: DataFrame, names: DataFrame, account: str, name: str) -> DataFrame:
    """``df`` with the name of an account in a further column; NULL where it has none."""
    return df.join(names.select(F.col("account_id").alias(account), F.col("name").alias(name)), account, "left")


def ordered_comments(comments: DataFrame) -> DataFrame:
    """Comments with their position on the page: threads in pre-order, siblings by creation (NULL last), then id.

    A comment whose parent is not on the page starts a thread; comments on or below a cycle come last. In the hierarchy a
    comment goes by a label that sorts as it does among its siblings, so its path of labels is its sort key: a sort by
    range gives the order, no ancestor is looked up, and neither a thread nor a page has to fit into one task.
    """
    late = F.when(F.col("created_at").isNull(), "1").otherwise("0")
    micros = F.lpad((F.coalesce(F.unix_micros("created_at"), F.lit(0)) + F.lit(2**62)).cast("string"), 19, "0")
    own = comments.select(F.col("page_id").alias("_page"), F.col("comment_id").alias("_id"), F.concat(late, micros, "comment_id").alias("_label"))
    parents = own.select("_page", F.col("_id").alias("_parent"), F.col("_label").alias("_above"))
    placed = comments.select("page_id", "comment_id", "parent_id", F.concat(late, micros, "comment_id").alias("label"))
    nodes = placed.join(parents, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("parent_id") == F.col("_parent")), "left")
    nodes = nodes.select(F.col("page_id").cast("string").alias("scope"), F.col("label").alias("id"), F.col("_above").alias("parent"))
    trees = resolve_hierarchy(nodes, unique=True).where("state = 'tree'")
    keys = trees.select(F.expr("substring(id, 21)").alias("comment_id"), F.col("path").alias("key"), "depth")
    keyed = comments.join(keys, "comment_id", "left").withColumn("stray", F.col("key").isNull())
    return rank_within(keyed, "page_id", ["stray", "key", F.col("created_at").asc_nulls_last(), "comment_id"], "position").drop("key", "stray")


def comment_text(body: Column | str) -> Column:
    """Markdown of a comment's body; its plain text where it is no document."""
    blocks, cells = extensions()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        with registered(blocks, cells):
            return pd.Series([_body(x) for x in s], dtype=object)

    return run(col(body))


def _body(text: str | None) -> str:
    plain = (text or "").strip()
    return (try_render(plain) or plain) if plain else "(empty comment)"


def comment_blocks(ordered: DataFrame, texts: DataFrame) -> DataFrame:
    """(page_id, position, block): one comment as Markdown, ready to be joined. ``texts`` has (comment_id, text): comments
    are put in order without their texts, which join them last."""
    author = F.coalesce(blank_to_null("author"), blank_to_null("author_id"), F.lit("Unknown Author"))
    day = F.coalesce(F.date_format("created_at", "d MMMM yyyy"), F.lit("unknown"))
    edited = F.when(F.col("updated_at") > F.col("created_at"), F.lit("\n(edited)\n")).otherwise("")
    block = F.concat(author, F.lit("\n"), day, F.lit("\n"), "text", F.lit("\n"), edited)
    return ordered.join(texts.select("comment_id", "text"), "comment_id").select("page_id", "position", block.alias("block"))


#: Comments that are joined to one part before the parts of a page are.
PART = 1_000


def comments_markdown(blocks: DataFrame) -> DataFrame:
    """(page_id, markdown): the comments section of each page.

    Parts of PART comments are joined first, each where it falls, so a page with a third of all comments is spread over
    many tasks until only its parts are left. The section itself is one text, as in the output.
    """
    joined = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    parts = blocks.groupBy("page_id", F.floor((F.col("position") - 1) / PART).alias("part")).agg(joined("position", "block").alias("text"))
    return parts.groupBy("page_id").agg(strip_white(F.concat(F.lit("## Comments\n\n"), joined("part", "text"))).alias("markdown"))
