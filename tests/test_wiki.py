"""Links, traversal, records, attachments, comments, files and configuration, case by case."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wikiloom.functions import files, urls
from wikiloom.operators import attachments, comments, links, ranking, records, traversal
from wikiloom.sources import store
from wikiloom.sources.config import Config


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


URLS = {
    "https://h/wiki/spaces/AB/pages/12/T": 12, "/wiki/spaces/AB/pages/12": 12, "https://h/x?pageId=7": 7, "https://h/spaces/A/pages/5?pageId=abc": 5,
    "https://h/x?pageId=99999999999999999999": 0, "https://h/x": 0, "": 0, "https://h/p q/spaces/A/pages/3": 3, "/wiki/pages/viewpage.action?pageId=8#part": 8, "/x?pageId=-4": -4,
}


def test_page_ids(spark):
    assert column(spark, list(URLS), urls.page_id) == list(URLS.values())


def test_crawl_targets(spark):
    cases = {"https://Wiki.Example.org/x": "internal", "https://wiki.example.org:8443/x": "external", "https://other/x": "external", "/x": "internal", "rel": "internal", "https://u:p@wiki.example.org/": "internal", " /y ": "internal", "/a b": "internal", "a b": "dropped"}
    assert column(spark, list(cases), lambda c: urls.crawl_target(c, "wiki.example.org")) == list(cases.values())
    assert column(spark, ["https://a/", "/x"], lambda c: urls.crawl_target(c, "")) == ["external", "internal"]


def test_seeds(spark):
    cases = {"123": 123, " 5 ": 5, "https://h/a?pageId=9": 9, "https://h/pages/44/x": 44, "https://h/a?pageId=x": None, "-3": None, "0": None, "none": None}
    assert column(spark, list(cases), urls.seed_page_id) == list(cases.values())
    assert column(spark, ["https://h/wiki/spaces/AB/pages/1", "https://h/x?a=/spaces/Q"], urls.space_key) == ["AB", None]


def test_attachment_filenames(spark):
    cases = {"plan v2.pdf": "9_plan_v2.pdf", "up\\down/left.csv": "9_up_down_left.csv", "..": "9_attachment", "//": "9___", " . lead.txt . ": "9__._lead.txt_._", "tab\there\x7f.md": "9_tabhere.md", "": "9_attachment", "Größe №3.pdf": "9_Größe_№3.pdf"}
    assert column(spark, list(cases), lambda c: files.attachment_filename(F.lit(9), c)) == list(cases.values())


def test_file_helpers(spark):
    assert files.page_filename("Ärger & Co: Plan!", "7") == "arger-and-co-plan_7.md" and files.page_filename("日本", "7") == "page_7.md"
    assert files.quote('a"b\\c\n\x01é\u200b') == '"a\\"b\\\\c\\n\\x01é\\u200b"'
    assert column(spark, ['a"b', "t\tx", "é", None], files.quoted) == ['"a\\"b"', '"t\\tx"', '"é"', None]
    assert files.inside_folder("/a/b", "/a/b/../b/c") and not files.inside_folder("/a/b", "/a/b/../c")
    assert column(spark, ["a/./b", " x.md ", "", "a\\b", "a//b/"], files.managed_path) == ["a/b", "x.md", None, "a/b", "a/b"]


def test_link_order_and_external_count(spark):
    adf = '{"url":"/wiki/spaces/A/pages/3","href" : "/wiki/spaces/A/pages/1","href":"https://o/wiki/spaces/A/pages/9","href":"/wiki/spaces/A/pages/3","href":"https://o/"}'
    df = spark.createDataFrame([(1, adf), (2, None), (3, "")], "page_id bigint, adf string")
    out = links.outgoing(links.edges(df, "page_id", "adf", "h")).collect()
    assert [(r.src, r.outgoing) for r in out] == [(1, ["1", "3"])]
    assert [tuple(r) for r in links.external_counts(df, "page_id", "adf", "h").collect()] == [(1, 5, 2)]


def test_incoming_and_pruned_links(spark):
    df = spark.createDataFrame([("1", ["3", "2"]), ("2", ["3", "3", "9"]), ("3", ["3"]), ("10", None)], "id string, outgoing_links array<string>")
    assert {r.id: r.incoming for r in links.incoming(df, "id", "outgoing_links").collect()} == {"1": [], "2": ["1"], "3": ["1", "2", "2", "3"], "10": []}
    gone = spark.createDataFrame([(2,)], "page_id bigint")
    assert {r.id: r.outgoing for r in links.without_deleted(df, "id", "outgoing_links", gone).collect()} == {"1": ["3"], "2": ["3", "3", "9"], "3": ["3"], "10": []}
    assert column(spark, [["123", "456", "123", "abc", "", "-1", " 7 "]], links.parse_ids, "array<string>") == [[123, 456, 7]]


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def reach(spark, pairs, depth, trashed=(), known=range(1, 7), **kw):
    pages = spark.createDataFrame([(i, "trashed " if i in trashed else None) for i in known], "page_id bigint, status string")
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "page_id bigint")
    found = traversal.traverse(seeds, graph(spark, pairs), depth, traversal.page_handler(pages), **kw).collect()
    assert len({r.page_id for r in found}) == len(found)
    return {r.page_id: (r.depth, r.state) for r in found}


def test_traversal(spark):
    ring = [(1, 8), (8, 6), (1, 9), (9, 6), (6, 4), (9, 7), (4, 1), (7, 7)]
    assert reach(spark, ring, 4, known=range(1, 10)) == {n: (d, "ok") for n, d in ((1, 0), (8, 1), (9, 1), (6, 2), (7, 2), (4, 3))}
    assert reach(spark, [(1, 2), (2, 3)], 4, trashed={2}) == {1: (0, "ok"), 2: (1, "deleted")}
    assert reach(spark, [(1, 2), (2, 3)], 1) == {1: (0, "ok"), 2: (1, "ok")}
    assert reach(spark, [(1, 99)], 3)[99] == (1, "deleted")
    with pytest.raises(traversal.FrontierTooLarge, match="saturated"):
        reach(spark, [(1, 2), (1, 3), (1, 4)], 2, max_frontier=2)


def test_traversal_equals_recursive_sql(spark):
    pairs = [(i, (i * 7 + k) % 40) for i in range(40) for k in (1, 3)]
    got = reach(spark, pairs, 3, known=range(40))
    graph(spark, pairs).createOrReplaceTempView("g")
    want = spark.sql("WITH RECURSIVE w(id, d) AS (SELECT 1L, 0 UNION ALL SELECT g.dst, d + 1 FROM w JOIN g ON g.src = w.id WHERE d < 3) SELECT id, min(d) AS d FROM w GROUP BY id")
    assert {k: v[0] for k, v in got.items()} == {r.id: r.d for r in want.collect()}


TEXT = "see [A](https://h/wiki/spaces/S/pages/2/T#top) and ![i](/x?pageId=2) [B](https://h/x?pageId=99) [C](two_2.md) `[D](/x?pageId=2)`"


def test_rewrite(spark):
    df = spark.createDataFrame([("1", TEXT), ("2", None), ("3", "no links")], "id string, text string")
    paths = spark.createDataFrame([(2, "two_2.md")], "page_id bigint, local_path string")
    got = {r.id: tuple(r)[1:] for r in links.rewrite(df, "id", "text", paths).collect()}
    assert got["1"] == ("see [A](two_2.md#top) and ![i](two_2.md) [B](https://h/x?pageId=99) [C](two_2.md) `[D](two_2.md)`", 5, 3)
    assert got["2"] == (None, 0, 0) and got["3"] == ("no links", 0, 0)
    again = links.rewrite(spark.createDataFrame([("1", got["1"][0])], "id string, text string"), "id", "text", paths).first()
    assert again.links_rewritten == 0 and again.markdown == got["1"][0]


def test_labels_and_attachments(spark):
    u, v = "https://h/wiki/spaces/S/pages/2", "https://h/wiki/spaces/S/pages/3"
    df = spark.createDataFrame([(1, f"[{u}]({u}) [{u}]({v}) [{v}]({v})"), (2, "none")], "page_id bigint, text string")
    titles = spark.createDataFrame([(2, " Two "), (3, "  ")], "page_id bigint, title string")
    assert {r.page_id: r.markdown for r in links.enrich_labels(df, "page_id", "text", titles).collect()} == {1: f"[Two]({u}) [{u}]({v}) [{v}]({v})", 2: "none"}
    files_ = spark.createDataFrame([(1, "1_a", "a.png", "f1", None), (1, "1_b", "f1", "f2", None), (1, None, "c", "f3", "lost"), (2, "2_x", "q", "q", None)], "page_id bigint, filename string, original_name string, file_id string, error string")
    text = spark.createDataFrame([(1, "![x](attachment://a.png) ![y](attachment://f1) ![z](attachment://f3) ![w](attachment://q)"), (3, "t")], "page_id bigint, text string")
    got = {r.page_id: r.markdown for r in links.rewrite_attachments(text, "page_id", "text", files_).collect()}
    assert got == {1: "![x](attachments/1_a) ![y](attachments/1_b) ![z](attachment://f3) ![w](attachment://q)", 3: "t"}


def test_macros(spark):
    ext = {"type": "extension", "attrs": {"extensionKey": "contentbylabel", "parameters": {"macroParams": {"cql": {"value": 'label = "x"'}}}}}
    text = json.dumps({"content": [{"type": "panel", "content": [ext]}, {"type": "text"}, ext]}, separators=(",", ":"))
    assert links.label_queries(text) == ['label = "x"'] * 2 and links.label_queries("{") == [] and links.label_queries(None) == []
    assert column(spark, ['{"extensionKey": "children"}', '{"extensionKey":"children"}', "x"], links.has_children_macro) == [True, True, False]


def test_outcomes_and_signature(spark):
    rows = [(1, "a", "x y", "t", 5, "f"), (1, "", "x", "t", 5, "f"), (1, "b", "big", "t", 3_000_000, None), (2, "z", None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, attachment_id string, filename string, media_type string, file_size bigint, file_id string")
    got = {(r.page_id, r.attachment_id): (r.filename, r.skipped, r.error is None) for r in attachments.outcomes(df, 2).collect()}
    assert got == {(1, "a"): ("1_x_y", False, True), (1, ""): (None, False, False), (1, "b"): (None, True, False), (2, "z"): ("2_attachment", False, True)}
    assert {r.page_id: r.signature for r in attachments.signatures(df.where("attachment_id <> 'b'")).collect()} == {1: "a|x y|t|5;|x|t|5", 2: "z|||"}


def test_comments(spark):
    t = lambda h: datetime(2026, 2, 13, h)
    rows = [("p1", 1, None, "a1", t(1), t(1), '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"Root"}]}]}'), ("c2", 1, "p1", "", t(3), t(4), "plain"), ("c1", 1, "p1", "a2", t(2), None, " "),
            ("p2", 1, "gone", "a1", None, None, None), ("x", 1, "y", "a1", t(1), t(1), "x"), ("y", 1, "x", "a1", t(2), t(2), "y"), ("o", 2, "p1", "a1", t(1), t(1), "other page")]
    df = spark.createDataFrame(rows, "comment_id string, page_id bigint, parent_id string, author_id string, created_at timestamp, updated_at timestamp, body string")
    ordered = comments.ordered_comments(df)
    assert [r.comment_id for r in ordered.where("page_id = 1").orderBy("position").collect()] == ["p1", "c1", "c2", "p2", "x", "y"]
    users = comments.users(spark.createDataFrame([("a1", " ", "Ann"), ("a2", "Bob ", None)], "account_id string, display_name string, public_name string"))
    named = comments.with_author(ordered, users, "author_id", "author")
    text = {r.page_id: r.markdown for r in comments.comments_markdown(comments.comment_blocks(named, df.select("comment_id", comments.comment_text("body").alias("text")))).collect()}
    assert text[1].startswith("## Comments\n\nAnn\n13 February 2026\nRoot\n\n\nBob\n13 February 2026\n(empty comment)\n\nUnknown Author\n13 February 2026\nplain\n\n(edited)\n\nAnn\nunknown\n(empty comment)")
    assert text[2] == "## Comments\n\nAnn\n13 February 2026\nother page"


def test_rank_within_a_hot_group(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 1, id) AS g", "-id AS o")
    got = {r.id: r.pos for r in ranking.rank_within(df, "g", ["o"], "pos").collect()}
    hot = sorted([i for i in range(3000) if i % 3 == 0] + [1], reverse=True)
    assert all(got[i] == n + 1 for n, i in enumerate(hot)) and sum(v == 1 for v in got.values()) == len(got) - len(hot) + 1


RECORD = {"id": "1", "title": 'A "t"', "version": 1, "crawled_at": "2025-01-02T03:04:05Z", "created_at": "0001-01-01T00:00:00Z", "attachments": [" b", "", "a"], "comment_count": 2}


def test_metadata_document(spark, tmp_path):
    good = {"crawl_started_at": "2025-01-01T00:00:00Z", "pages": {"1": RECORD}}
    (tmp_path / "m.json").write_text(json.dumps(good))
    df = store.read_metadata(spark, f"file://{tmp_path}/m.json")
    row = df.first()
    assert row.id == "1" and row.created_at is None and row.crawled_at == datetime(2025, 1, 2, 3, 4, 5)
    text = records.front_matter(df.withColumn("is_seed", F.lit(True))).first().front_matter
    assert text.startswith('---\npage_id: "1"\ntitle: "A \\"t\\""\n') and text.endswith('comment_count: 2\nattachments:\n  - "a"\n  - "b"\n---\n')
    body = spark.createDataFrame([(text + "\n\nBody",), ("---\nx: 1\n---\nkept",), ("plain",)], "t string").select(records.strip_front_matter("t").alias("t"))
    assert [r.t for r in body.collect()] == ["Body", "---\nx: 1\n---\nkept", "plain"]
    (tmp_path / "bad.json").write_text(json.dumps({"pages": {"2": RECORD}}))
    with pytest.raises(ValueError, match="key differs"):
        store.read_metadata(spark, f"file://{tmp_path}/bad.json")
    store.write_metadata(df, str(tmp_path / "lines.json"))
    assert store.read_metadata(spark, str(tmp_path / "lines.json")).first() == row


def test_snapshot_pointer(spark, tmp_path):
    assert store.read_snapshot(spark, str(tmp_path)) is None
    for n in (1, 2):
        store.commit(str(tmp_path), n, store.write_snapshot(spark.range(n), str(tmp_path), n), {"completed": {"n": n}})
    store.write_snapshot(spark.range(3), str(tmp_path), 3)  # a run that failed before it was committed
    assert store.read_snapshot(spark, str(tmp_path)).count() == 2 and store.current(str(tmp_path))["checkpoints"] == {"completed": {"n": 2}}
    store.write_pages(spark.createDataFrame([("a/b.md", "x")], "local_path string, text string"), str(tmp_path / "out"))
    assert (tmp_path / "out/a/b.md").read_text() == "x"
    store.clear_folder(str(tmp_path / "out"))
    assert not list((tmp_path / "out").iterdir())
    for bad in ("", ".", "/"):
        with pytest.raises(ValueError):
            store.clear_folder(bad)


def test_reconcile_prune_index_and_checkpoints(spark):
    schema = "id string, title string, local_path string, source_url string, attachments array<string>"
    old = spark.createDataFrame([("1", "A", "a_1.md", "", ["attachments/x"]), ("2", "B", "b_2.md", "http://s", None)], schema)
    new = spark.createDataFrame([("1", "A2", "a2_1.md", "", ["attachments/x"]), ("2", "B", "b_2.md", "http://s", None)], schema)
    assert {r.path: r.outcome for r in records.reconcile(old, new).collect()} == {"a_1.md": "deleted", "a2_1.md": "added", "attachments/x": "updated", "b_2.md": "updated"}
    crawled = spark.createDataFrame([(1, "ok"), (2, "deleted")], "page_id bigint, state string")
    assert [r.id for r in records.prune(new, crawled).collect()] == ["1"]
    seeds = spark.createDataFrame([(0, "2"), (1, "7"), (2, "1")], "pos int, seed_id string")
    lines = [r.line for r in records.index_lines(new, seeds).orderBy("pos").collect()]
    assert lines == ["- [B](b_2.md) - source: <http://s>", "- Page 7 (not present in current crawl output)", "- [A2](a2_1.md)"]
    assert "- No configured" in records.index_page([], "a", "b") and records.checkpoint_text(None) == "not available"
    assert records.checkpoint_text({"mode": "full", "started": "s", "completed": "c"}) == "mode=full, started=s, completed=c"
    t = [datetime(2025, 1, d) for d in (1, 2)]
    cp = "struct<mode:string,started:timestamp,completed:timestamp>"
    state = spark.createDataFrame([(1, ("full", t[0], t[1]), None), (2, ("odd", t[0], t[1]), ("full", t[1], t[0])), (3, ("full", None, t[0]), (None, None, None))], f"run_id int, last_completed {cp}, last_successful {cp}")
    assert {(r.run_id, r.checkpoint): r.error for r in records.checkpoint_errors(state).collect()} == {(2, "last_completed"): "mode", (2, "last_successful"): "completed before started", (3, "last_completed"): "partial"}
    moved = records.advance_checkpoints(state.where("run_id = 1"), F.lit("updates"), F.lit(t[0]), F.lit(t[1]), F.lit(1)).first()
    assert moved.last_completed.mode == "updates" and moved.last_successful is None


def test_summary_and_metrics(spark):
    df = spark.createDataFrame([("dirty",), ("clean",), ("clean",), ("deleted",)], "kind string")
    m = records.run_metrics(df).first().asDict()
    assert m == {"total": 4, "deleted": 1, "rerendered": 1, "reused": 2, "reachable": 3, "saved_percent": 66.7}
    assert "2 kept (66.7% saved)" in records.summary("updates", m, {0: 1, 1: 3}) and "dry run" in records.summary("full", m, {}, True)
    files = {"added": 1, "deleted": 2}
    assert "files would be added 1, updated 0, removed as stale 2" in records.summary("full", m, {}, True, files=files) and "files added 1" in records.summary("full", m, {}, files=files)
    assert records.run_metrics(df.limit(0)).first().saved_percent == 0.0


def test_config():
    c = Config.from_json('{"username": "u", "seeds": ["https://h/wiki/spaces/A"]}', {"WIKI_API_TOKEN": "t"})
    c.check()
    assert c.base_url() == "https://h/wiki" and Config(seeds=["https://h/a"]).base_url() == "https://h"
    with pytest.raises(ValueError, match="username is required; .*api_token.*seed 'x'.*max_retries"):
        Config(seeds=["x"], max_retries=0).check()


def test_blobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"12345")
    (tmp_path / "in" / "b").write_bytes(b"1" * 50)
    blobs = attachments.read_blobs(spark, f"file://{tmp_path}/in", 10)
    planned = spark.createDataFrame([("1_a.txt", "a", None), ("1_b.txt", "b", None), (None, "c", "no id")], "filename string, attachment_id string, error string")
    attachments.copy_blobs(planned, blobs, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["1_a.txt"] and (tmp_path / "out/1_a.txt").read_bytes() == b"12345"
