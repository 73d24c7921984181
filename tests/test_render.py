"""ADF to Markdown, one case per rule."""

import json

import pytest

from pyspark.sql import functions as F

from wikiloom.operators import render
from wikiloom.operators.render import BadDocument, Place, cell_html, has_title, render_document, tidy


def doc(*nodes):
    return render_document(json.dumps({"type": "doc", "version": 1, "content": list(nodes)})).strip()


def t(text, *marks):
    return {"type": "text", "text": text, "marks": [m if isinstance(m, dict) else {"type": m} for m in marks]}


def n(type_, *content, **attrs):
    return {"type": type_, "attrs": attrs, "content": list(content)}


def p(*content):
    return n("paragraph", *[t(c) if isinstance(c, str) else c for c in content])


CASES = [
    ([n("heading", t("Goals"), level=2), p("Text.")], "## Goals\n\nText."),
    ([n("heading", t("x"), level=9)], "###### x"),
    ([p("  ")], ""),
    ([n("bulletList", n("listItem", p("a"), n("bulletList", n("listItem", p("b")))), n("listItem", p("c")))], "- a\n\n    - b\n- c"),
    ([n("orderedList", n("listItem", p("one")), n("listItem", p("two")))], "1. one\n2. two"),
    ([n("taskList", n("taskItem", t("do"), state="DONE"), n("taskItem", t("open"), state="TODO"))], "- [x] do\n- [ ] open"),
    ([n("decisionList", n("decisionItem", t("yes"), state="DECIDED"))], "- [x] yes"),
    ([n("codeBlock", t("a = 1\n\nb"), language="py")], "```py\na = 1\n\nb\n```"),
    ([n("blockquote", p("q")), n("rule"), p("after")], "> q\n\n---\n\nafter"),
    ([n("panel", p("careful"), panelType="warning")], "> **Warning:** careful"),
    ([n("expand", p("body"), title="More")], "**More**\n\nbody"),
    ([p(t("x", "em", "strong", "code"))], "_**`x`**_"),
    ([p(t("2", {"type": "subsup", "attrs": {"type": "sup"}}), t("u", "underline", "strike"))], "<sup>2</sup><u>~~u~~</u>"),
    ([p(t("go", {"type": "link", "attrs": {"href": "https://x.example/a"}}), t("no", {"type": "link", "attrs": {}}))], "[go](https://x.example/a)no"),
    ([p(n("date", timestamp="1760000000000"), " ", n("date", timestamp="soon"), n("date", timestamp=5))], "9 October 2025 soon"),
    ([p(n("mention", text="@Ann"), " ", n("emoji", shortName=":x:"), " ", n("status", text="DONE"))], "@Ann :x: **DONE**"),
    ([p(n("inlineCard", url="https://x.example/1"))], "[https://x.example/1](https://x.example/1)"),
    ([n("mediaSingle", n("media", id="f1", alt="shot"))], "![shot](attachment://f1)"),
    ([n("mediaSingle", n("media", alt="none"))], ""),
    ([n("extension", extensionKey="jira", parameters={"key": {"value": "AB-1"}})], "[AB-1](https://jira.atlassian.net/browse/AB-1)"),
    ([n("bodiedExtension", p("kept"), extensionKey="other")], "kept"),
    ([n("unknownThing", p("kept"))], "kept"),
    ([n("table", n("tableRow", n("tableHeader", p("A")), n("tableHeader", p("B|C"))), n("tableRow", n("tableCell", p("1"))))], "| A | B\\|C |\n| --- | --- |\n| 1 |  |"),
    (
        [n("table", n("tableRow", n("tableCell", p("wide"), colspan=2, rowspan=3)), n("tableRow", n("tableHeader", n("codeBlock", t("v")))))],
        '<table>\n<tr><td colspan="2" rowspan="3"><p>wide</p></td></tr>\n<tr><th><pre><code>v</code></pre></th></tr>\n</table>',
    ),
    ([n("caption", t("below"))], "*below*"),
]


@pytest.mark.parametrize("nodes, expected", CASES)
def test_nodes(nodes, expected):
    assert doc(*nodes) == expected


def test_cells():
    assert cell_html(n("tableCell", n("heading", t("S"), level=3), n("bulletList", n("listItem", p("i"))), t("bare")), Place()) == "<h3>S</h3><ul><li><p>i</p></li></ul>"


@pytest.mark.parametrize("bad", ["", "{", "[]", '{"content": {}}', '{"content": [{"type": 5}]}', '{"content": ["x"]}', None])
def test_broken(bad):
    with pytest.raises(BadDocument):
        render_document(bad)


def test_keys_in_any_case():
    assert render_document('{"Content": [{"TYPE": "paragraph", "CONTENT": [{"Type": "text", "Text": "x"}]}]}').strip() == "x"


def test_tidy():
    assert tidy("a\n\n\n\nb") == "a\n\nb"
    assert tidy("a\n# h\nb") == "a\n\n# h\n\nb"
    assert tidy("a\n---\nb") == "a\n\n---\n\nb"
    assert tidy("a\n| x |\n| - |\nb") == "a\n\n| x |\n| - |\n\nb"
    assert tidy("```\n# no\n```") == "```\n# no\n```"


def test_title():
    assert has_title("# Some Title\nx", "some title") and not has_title("## Some\n", "Some")


def test_documents_nest_as_deeply_as_they_like(spark):
    for kind, depth in (("panel", 2_000), ("layoutSection", 20_000), ("bulletList", 1_000)):
        deep = f'{{"type":"{kind}","content":[' * depth + '{"type":"paragraph","content":[{"type":"text","text":"x"}]}' + "]}" * depth
        assert "x" in render.render_document(f'{{"type":"doc","content":[{deep}]}}')
    flat = spark.createDataFrame([(f'{{"content":[{deep}]}}',)], "d string").select(render.rendered(F.col("d")).alias("m"))
    assert "x" in flat.first().m


def test_extensions_reach_the_workers(spark):
    def shout(node, place, out):
        out.add(render.attr_text(node, "word").upper())

    docs = spark.createDataFrame([('{"content":[{"type":"shout","attrs":{"word":"hey"}}]}',)], "d string")
    with render.registered({"shout": shout}, {}):
        column = render.rendered(F.col("d"))
    assert docs.select(column.alias("m")).first().m == "HEY"
    assert docs.select(render.rendered(F.col("d")).alias("m")).first().m == "" and "shout" not in render.BLOCKS
