"""Plans: what the scans read, and what the joins are."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

FOLDER = entry.SMALL
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are not here")


def plan(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().toString()


def scans(text):
    return re.findall(r"FileScan parquet \[([^\]]*)\]", text)


@pytest.mark.parametrize("name", ["p1_found", "incoming_links", "author_names", "children_by_parent", "spaces", "seed_flags", "front_matter", "prune_deleted_links", "artifact_reconcile", "renamed_pages"])
def test_bodies_are_not_read(spark, name):
    text = plan(spark, name)
    assert scans(text) and not any("storage_format_sample" in s or "adf" in s for s in scans(text))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_joins(spark, name):
    physical = plan(spark, name).split("== Physical Plan ==")[-1]
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical


@pytest.mark.parametrize("name", ["incoming_links", "spaces", "front_matter", "rewrite_links"])
def test_the_run_reaches_the_scan(spark, name):
    assert "EqualTo(run_id," in plan(spark, name)


@pytest.mark.parametrize("name", [n for n in ("link_edges", "crawl_stats", "outgoing_links", "label_enrich", "macro_flags", "rendered_pages", "p2_found") if n in entry.queries()])
def test_no_body_is_shuffled(spark, name):
    physical = plan(spark, name).split("== Physical Plan ==")[-1]
    bodies = re.findall(r"(?:adf|storage_format_sample|text)#\d+", " ".join(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", physical)))
    # What an exchange carries is the output of the node below it.
    below = re.findall(r"Exchange [^\n]*\n[ :|+-]*(?:\*\(\d+\) )?(\w+ [^\n]*)", physical)
    whole = re.compile(r"[\[,] ?(?:adf|storage_format_sample|_body|_text|text)#\d+[,\]]")  # not as an argument
    assert not bodies and not any(whole.search(b) for b in below if b.startswith(("Project", "FileScan", "Filter")))


def test_nothing_uses_local_checkpoints():
    for f in Path(entry.__file__).parent.glob("wikiloom/**/*.py"):
        assert "localCheckpoint(" not in f.read_text(), f
