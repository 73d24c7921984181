"""Whole runs on a small wiki, and the streaming forms."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wikiloom.operators import links
from wikiloom.operators.comments import current_comments
from wikiloom.operators.traversal import FrontierTooLarge
from wikiloom.plans import pipeline
from wikiloom.sources import store
from wikiloom.streaming.updates import edits_per_window, process_changes

BASE, NOW = "https://h.example/wiki", datetime(2026, 1, 2)
PAGES = "page_id bigint, title string, status string, created_at string, author_id string, parent_id string, version struct<number:int, created_at:string, author_id:string>, space_key string, adf string, webui string"


def adf(*hrefs, macro=None):
    kids = [{"type": "paragraph", "content": [{"type": "text", "text": f"to {h}", "marks": [{"type": "link", "attrs": {"href": h}}]} for h in hrefs]}]
    if macro:
        kids.append({"type": "extension", "attrs": {"extensionKey": "contentbylabel", "parameters": {"macroParams": {"cql": {"value": macro}}}}})
    return json.dumps({"type": "doc", "content": kids}, separators=(",", ":"))


def page(i, body, title=None, version=1, status="current"):
    return (i, title or f"Page {i}", status, "2025-01-01T00:00:00Z", "a1", None, (version, "2025-01-02T00:00:00.000Z", "a1"), "S", body, f"{BASE}/pages/viewpage.action?pageId={i}")


def link(i):
    return f"/wiki/spaces/S/pages/{i}/T"


def inputs(spark, pages, previous=None):
    return pipeline.Inputs(
        spark.createDataFrame(pages, PAGES),
        spark.createDataFrame([("c1", 2, None, "a1", NOW, NOW, adf(link(5)))], "comment_id string, page_id bigint, parent_id string, author_id string, created_at timestamp, updated_at timestamp, body string"),
        spark.createDataFrame([("t1", 1, "x y.png", "image/png", 5, "u", "f1")], "attachment_id string, page_id bigint, filename string, media_type string, file_size bigint, download_url string, file_id string"),
        spark.createDataFrame([("a1", "Ann", None)], "account_id string, display_name string, public_name string"),
        [f"{BASE}/spaces/S/pages/1/T"],
        spark.createDataFrame([("label = x", 0, 4), ("label = x", 1, 9)], "cql string, pos int, page_id bigint"),
        previous,
    )


WIKI = [page(1, adf(link(2), link(3), "https://other/x", macro="label = x")), page(2, adf(link(1))), page(3, adf(link(2)), status="trashed"), page(4, adf()), page(5, "{broken"), page(6, adf())]


@pytest.fixture(scope="module")
def full(spark):
    return pipeline.run(inputs(spark, WIKI), BASE, NOW)


AT = {"mode": "full", "started": "s", "completed": "c"}


def test_full_then_updates(spark, tmp_path, full):
    got = {r.id: r for r in full.records.collect()}
    assert set(got) == {"1", "2", "4"} and full.depths == {0: 1, 1: 4, 2: 1}
    assert got["1"].outgoing_links == ["2", "4"] and got["2"].incoming_links == ["1"] and got["1"].incoming_links == ["2"]
    assert got["1"].storage_format_sample.startswith("# Page 1\n\n") and "](page-2_2.md)" in got["1"].storage_format_sample
    assert "## Related pages\n\n- [Page 4](page-4_4.md)\n- [9](https://h.example/wiki/pages/viewpage.action?pageId=9)" in got["1"].storage_format_sample
    assert got["1"].attachments == ["attachments/1_x_y.png"] and got["2"].storage_format_sample.endswith("[to /wiki/spaces/S/pages/5/T](/wiki/spaces/S/pages/5/T)\n")
    pipeline.export(full, inputs(spark, WIKI), str(tmp_path), 1)
    text = (tmp_path / "page-1_1.md").read_text()
    assert text.startswith('---\npage_id: "1"\n') and "is_seed: true" in text and "created_by: \"Ann\"" in text

    changed = [page(1, adf(link(2)), title="New title", version=2), *WIKI[1:]]
    second = pipeline.run(inputs(spark, changed, full.records), BASE, NOW, mode="updates")
    kinds = {r.page_id: r.kind for r in second.classified.collect()}
    assert kinds == {1: "dirty", 2: "clean", 5: "dirty"} and second.metrics["reused"] == 1
    now = {r.id: r for r in second.records.collect()}
    assert set(now) == {"1", "2"} and now["2"].storage_format_sample == got["2"].storage_format_sample and now["2"].incoming_links == ["1"]
    assert {r.path: r.outcome for r in second.artifacts.collect()} == {"page-1_1.md": "deleted", "new-title_1.md": "added", "page-2_2.md": "updated", "page-4_4.md": "deleted", "attachments/1_x_y.png": "updated"}
    pipeline.export(second, inputs(spark, changed), str(tmp_path), 2)
    assert not (tmp_path / "page-1_1.md").exists() and (tmp_path / "new-title_1.md").exists()
    assert "- [New title](new-title_1.md) - source: <" in (tmp_path / "index.md").read_text()
    (tmp_path / "page-2_2.md").write_text("kept as it is")
    pipeline.export(second, inputs(spark, changed, second.records), str(tmp_path), 3)
    assert (tmp_path / "page-2_2.md").read_text() == "kept as it is"


def test_command_line(spark, tmp_path, capsys):
    from wikiloom.__main__ import main

    tables = inputs(spark, WIKI)
    for name in ("api_pages", "api_comments", "api_attachments", "api_users"):
        getattr(tables, name).write.parquet(f"file://{tmp_path}/t/{name}.parquet")
    (tmp_path / "c.json").write_text(json.dumps({"username": "u", "api_token": "t", "seeds": [f"{BASE}/spaces/S/pages/1/T"]}))
    common = ["--config", str(tmp_path / "c.json"), "--tables", str(tmp_path / "t"), "--out", str(tmp_path / "o")]
    assert main(["validate", *common]) == 0
    assert main(["run", *common, "--dry-run"]) == 0 and not (tmp_path / "o").exists()
    assert main(["run", *common]) == 1  # a page is broken, so the run is complete but not successful
    assert {"page-1_1.md", "index.md", "metadata.json", "CURRENT"} <= {p.name for p in (tmp_path / "o").iterdir()}
    assert set(store.current(str(tmp_path / "o"))["checkpoints"]) == {"completed"} and not (tmp_path / "o/attachments").exists()
    assert "- Last successful crawl: not available\n- Last completed crawl: mode=full, started=" in (tmp_path / "o/index.md").read_text()
    assert main(["run", *common, "--mode", "updates", "--run-id", "2"]) == 1
    assert "2 kept (66.7% saved)" in capsys.readouterr().out
    (tmp_path / "o/stale.md").write_text("x")
    (tmp_path / "t/blobs").mkdir()
    (tmp_path / "t/blobs/t1").write_bytes(b"12345")
    (tmp_path / "c.json").write_text(json.dumps({"username": "u", "api_token": "t", "seeds": [f"{BASE}/spaces/S/pages/1/T"], "download_attachments": True}))
    assert main(["run", *common, "--run-id", "3"]) == 1 and not (tmp_path / "o/stale.md").exists()
    assert (tmp_path / "o/attachments/1_x_y.png").read_bytes() == b"12345" and "attachments: 1 stored" in capsys.readouterr().out
    (tmp_path / "c.json").write_text(json.dumps({"username": "u", "api_token": "t", "seeds": [f"{BASE}/spaces/S/pages/1/T"], "max_queue": 1}))
    with pytest.raises(FrontierTooLarge):
        main(["run", *common])


def test_a_run_that_fails_while_it_writes_leaves_the_checkpoints(spark, tmp_path, monkeypatch, full):
    pipeline.export(full, inputs(spark, WIKI), str(tmp_path), 1, lambda: {"completed": AT})
    for step in ("write_pages", "write_metadata", "write_snapshot", "remove_files"):
        with monkeypatch.context() as m:
            m.setattr(store, step, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                pipeline.export(full, inputs(spark, WIKI), str(tmp_path), 2, lambda: {"completed": AT, "successful": AT})
        assert store.current(str(tmp_path))["checkpoints"] == {"completed": AT} and store.current(str(tmp_path))["run_id"] == 1


def test_kept_pages_lose_links_to_deleted_ones(spark, full):
    later = [*WIKI[:3], page(4, adf(), status="trashed"), *WIKI[4:]]
    before = full.records.withColumn("local_path", F.when(F.col("id") != "2", F.col("local_path")).otherwise(" "))
    second = pipeline.run(inputs(spark, later, before), BASE, datetime(2026, 2, 1), mode="updates")
    got = {r.id: r for r in second.records.collect()}
    assert got["2"].local_path == "page-2_2.md"
    assert set(got) == {"1", "2"} and got["1"].outgoing_links == ["2"] and got["1"].crawled_at == NOW
    assert {r.page_id: (r.kind, r.title) for r in second.classified.collect()}[4] == ("deleted", "Page 4")
    assert second.metrics["failed"] == 1 and second.metrics["attachments_kept"] == 1 and second.metrics["comments"] == 0


def test_without_attachments(spark):
    off = pipeline.run(inputs(spark, WIKI), BASE, NOW, download_attachments=False)
    got = {r.id: r for r in off.records.collect()}
    assert got["1"].attachments == [] and got["1"].attachment_signature == "" and off.outcomes is None
    again = pipeline.run(inputs(spark, WIKI, off.records), BASE, NOW, mode="updates", download_attachments=False, dry_run=True)
    assert {r.page_id: r.kind for r in again.classified.collect()}[1] == "clean"
    assert {r.page_id: r.kind for r in pipeline.run(inputs(spark, WIKI, off.records), BASE, NOW, mode="updates", dry_run=True).classified.collect()}[1] == "dirty"


def test_query_hits_keep_their_macro_however_many_they_are(spark):
    body = json.dumps({"content": [{"type": "extension", "attrs": {"extensionKey": "contentbylabel", "parameters": {"macroParams": {"cql": {"value": q}}}}} for q in ("a", "b")]}, separators=(",", ":"))
    given = inputs(spark, [page(1, body)])
    given.related = spark.createDataFrame([("a", i, 10 + i) for i in range(1001)] + [("b", 0, 5000)], "cql string, pos int, page_id bigint")
    linked = pipeline.sources_of_links(given.api_pages)
    edges = pipeline.all_edges(linked, given.api_pages.select("page_id", "parent_id"), current_comments(given.api_comments, targets=links.targets_in("body")).limit(0), given.related, "h.example")
    order = [r.dst for r in edges.orderBy("at").collect()]
    assert order == [*range(10, 1011), 5000]


def test_children_and_their_order(spark):
    pages = [page(1, adf()), *[(*page(i, adf())[:5], "1", *page(i, adf())[6:]) for i in (3, 2)]]
    given = inputs(spark, pages)
    got = [{r.page_id for r in pipeline.run(given, BASE, NOW, dry_run=True, follow_children=f).reached.collect()} for f in (False, True)]
    assert got == [{1}, {1, 2, 3, 5}]


def test_dry_run_takes_the_same_decisions(spark):
    dry = pipeline.run(inputs(spark, WIKI), BASE, NOW, dry_run=True)
    assert dry.links == {"total_pages": 6, "total_links": 4, "unique_targets": 4, "external_skipped": 1}
    assert dry.records is None and dry.metrics["deleted"] == 2 and dry.depths == {0: 1, 1: 4, 2: 1}


def test_unresolved_seed_and_mode(spark):
    with pytest.raises(ValueError, match="cannot be resolved"):
        pipeline.run(inputs(spark, WIKI[1:]), BASE, NOW)
    with pytest.raises(ValueError, match="mode"):
        pipeline.run(inputs(spark, WIKI), BASE, NOW, mode="other")


FEED = "id string, title string, version int, attachment_signature string, received_at timestamp"


def test_streams(spark, tmp_path):
    at = [datetime(2026, 1, 1, h) for h in range(5)]
    source, seen = tmp_path / "in", []
    rows = [[("1", "a", 1, None, at[0]), ("2", "a", 1, None, at[0])], [("1", "a", 1, None, at[1]), ("2 ", "a ", 2, " ", at[1])]]
    for batch in rows:
        spark.createDataFrame(batch, FEED).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(FEED).parquet(f"file://{source}")
        q = process_changes(stream, f"file://{tmp_path}/ledger", lambda df: seen.append(sorted(r.key for r in df.collect())), f"file://{tmp_path}/cp")
        assert q.awaitTermination(120)
    assert seen == [[1, 2], [2]]
    spark.createDataFrame([("9", "z", 1, None, at[4])], FEED).coalesce(1).write.mode("append").parquet(f"file://{source}")
    stream = spark.readStream.schema(FEED).parquet(f"file://{source}")
    q = edits_per_window(stream, late="10 minutes").writeStream.format("memory").queryName("edits").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    # The repeat of page 1 counts once; the window of the last row is still open.
    assert {(r.window.start.hour, r.deliveries, r.pages) for r in spark.table("edits").collect()} == {(0, 2, 2), (1, 1, 1)}
