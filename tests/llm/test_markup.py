"""Structures of text in mixed mark-up."""

import random

import pytest
from pyspark.sql import functions as F

from wikiloom.llm.markup import Boxes, parse_markup, plain, structures, walk_markup

H, L, C, M = "heading", "list_item", "code", "formula"
CASES = [
    ("# A *b* `c_d` #\n\nB **x**\n=====\n\npara\n---\n", False, [(H, "A b c_d"), (H, "B x"), (H, "para")]),
    ("- [x] done [l](http://x)\n  - inner __b__\n  more\n* next\n1) one", False, [(L, "done l"), (L, "inner b more"), (L, "next"), (L, "one")]),
    ("```py\n# no\n- no\n```\n~~~\nx  y\n~~~", False, [(C, "# no - no"), (C, "x y")]),
    ("text\n\n    a = 1\n    b\n\nmore", False, [(C, "a = 1 b")]),
    ("costs $5 to $9, then $x_1 + 2$ and \\(y\\) end\n\n$$\na\n$$\n\n\\[ z \\]\n\n\\begin{equation}\nq &= 1\n\\end{equation}", False, [(M, "x_1 + 2"), (M, "y"), (M, "a"), (M, "z"), (M, "q &= 1")]),
    ("h2. Head {color:red}r{color}\n\n# one *b*\n# two [t|http://x]\n** in {{m}}\n\n{code:title=x}\n# c\n{code}\n{noformat}n{noformat}", True, [(H, "Head r"), (L, "one b"), (L, "two t"), (L, "in m"), (C, "# c"), (C, "n")]),
    ("\\section*{A \\& \\textbf{b} max\\_size}\n\\begin{itemize}\n  \\item one \\emph{two}\n  rest\n  \\begin{enumerate}\\item x\n\\end{enumerate}\n\\end{itemize}\n\\begin{lstlisting}\n%c\n\\end{lstlisting}", False, [(H, "A & b max_size"), (L, "one two rest"), (L, "x"), (C, "%c")]),
    ('<h2 id="s"\n class="a">A &amp; <b>b</b></h2><ul><li><p>one</p><ul><li>in&nbsp;x</li></ul></li></ul><pre><code class="l">a &lt; b\n c</code></pre>', False, [(H, "A & b"), (L, "in x"), (L, "one"), (C, "a < b c")]),
    ('<ac:structured-macro ac:name="code"><ac:parameter ac:name="l">x</ac:parameter><ac:plain-text-body><![CDATA[if (a < b) {}]]></ac:plain-text-body></ac:structured-macro><p>t \\(a &lt; b\\)</p>', False, [(C, "if (a < b) {}"), (M, "a < b")]),
    ("| a | b |\n| --- | --- |\n| # no | - no |", False, []),
    ("<p>open\n\n# head\n\n<p>a<p>b</p>\n- item\n\n<h2>cut\n\n- more", False, [(H, "head"), (L, "item"), (H, "cut"), (L, "more")]),
    ("\\[ a \\\\[2pt] b \\] and \\(x\\)", False, [(M, "a \\\\[2pt] b"), (M, "x")]),
    ("text \\[ a \\\\[2pt] b \\] end", False, [(M, "a \\\\[2pt] b")]),
    ("<pre>a\n\nb</pre>", False, [(C, "a b")]),
    ("", False, []),
    (None, True, []),
]


@pytest.mark.parametrize("text, wiki, expected", CASES)
def test_structures(text, wiki, expected):
    assert sorted(parse_markup(text, wiki)) == sorted(expected)


@pytest.mark.parametrize("broken", ["<ul><li>x", "</li></ul>", "```", "$$", "\\begin{itemize}\n\\item x", "{code}", "\\section{x", "<pre>a", "[x](", "**", "\\begin{verbatim}", "<p", "<", "\\item", "- ", "#", "h1. "])
def test_broken_markup_ends(broken):
    list(parse_markup(broken, False))
    list(parse_markup(broken + "\n\n" + broken, True))


def test_plain():
    assert plain("a*b < c, 3 > 2 max_batch_size \\*x\\* &copy; <u>u</u>") == "a*b < c, 3 > 2 max_batch_size *x* © u"


def test_host_decides_where_a_page_does_not(spark):
    wiki = "h1. Title\n\n# item"
    rows = [(1, "a", wiki), (2, "a", wiki), (3, "a", "# only"), (4, "b", "# only"), (5, None, "# only"), (6, "a", "```\nx\n```\n# only"), (7, "a", None), (8, "a", ""), (9, "b", "# one\n# two")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id int, host string, text string, kind string")
    got = {(r.page_id, r.kind, r.content) for r in structures(df, "page_id", "host", "text").collect()}
    assert {(3, L, "only"), (4, H, "only"), (5, H, "only"), (6, H, "only"), (9, L, "one"), (9, L, "two")} <= got and not {r[0] for r in got} & {7, 8}
    assert structures(df.limit(0), "page_id", "host", "text").count() == 0


def test_long_text_and_repeats(spark):
    text = "- item\n" * 50_000
    df = spark.createDataFrame([(1, "h", text), (1, "h", text), (None, "h", "- x")], "page_id int, host string, text string")
    got = structures(df, "page_id", "host", "text").groupBy("page_id").agg(F.count("*").alias("n")).collect()
    assert {r.page_id: r.n for r in got} == {1: 1, None: 1}


def test_styling_of_any_depth_goes():
    deep = "".join(f"\\{c}{{" for c in ("textbf", "emph", "underline", "texttt", "textsf") * 400) + "deep" + "}" * 2000
    assert plain(deep) == "deep" and plain("\\textbf{a {b} \\emph{c}} \\emph{d") == "a {b} c \\emph{d"
    assert plain("\\href{http://x}{\\emph{y}}\\label{z} \\{k\\}") == "y {k}"


PAGE = '<div class="top-{n} menu"><ul><li><a href="/a">Home {n}</a></li><li><a href="/b">Spaces</a></li></ul></div><div class="content-{n}"><h2>Own {n}</h2><p>{text}</p><ul><li>kept {n}</li></ul></div><div class="footer"><p>All rights reserved</p><ul><li>imprint</li></ul></div>'


def paged(spark, pages):
    return spark.createDataFrame([(*p, 1) for p in pages], "page_id int, host string, text string, kind int")


def test_the_vote_on_paths_decides_what_is_content(spark):
    usual = [(n, "a", PAGE.format(n=n, text="words of the page itself " * 9)) for n in range(5)]
    # A page that would choose for itself its long list of links' sibling; the host's path is what it shares with the others.
    odd = (9, "a", PAGE.format(n=9, text="short") + '<div class="archive">' + "<p>old remark without any link at all</p>" * 20 + "<ul><li>odd</li></ul></div>")
    other = (10, "b", odd[2])
    df = paged(spark, [*usual, odd, other, (11, "a", "- plain\n")])
    voted = {(r.page_id, r.content) for r in structures(df, "page_id", "host", "text").collect()}
    free = {(r.page_id, r.content) for r in structures(df, "page_id", "host", "text", vote_paths=False).collect()}
    assert {(n, f"Own {n}") for n in (0, 1, 2, 3, 4, 9)} | {(9, "kept 9"), (10, "odd"), (11, "plain")} <= voted
    assert not {"Spaces", "imprint"} & {c for _, c in voted} and (9, "odd") not in voted
    assert {(0, "Spaces"), (0, "imprint"), (9, "odd")} <= free and voted < free


def test_scores_and_paths():
    boxes = Boxes()
    assert list(walk_markup('<div class="B2 a"><p>12345</p><nav><a href="x">123</a></nav></div>', False, boxes)) == []
    assert boxes.scores() == {"": 2, "div.a.b#": 2, "div.a.b#>nav": -3} and boxes.best() == ""


def test_only_the_latest_row_counts(spark):
    rows = [(1, "h", "- old", 1), (1, "h", "- new", 2), (2, "h", "- gone", 1), (2, "h", None, 2), (3, "h", "- a", None), (3, "h", "- b", 5), (4, "h", "- only", None)]
    df = spark.createDataFrame(rows, "page_id int, host string, text string, at int")
    got = {(r.page_id, r.content) for r in structures(df, "page_id", "host", "text", "at").collect()}
    assert got == {(1, "new"), (3, "b"), (4, "only")}


WORDS = ["alpha", "beta 2", "max_size", "the index", "A & B", "a < b", "50 %", "naïve", "x-ray", "(see note)", "C:", "日本語"]


def written(dialect, kind, text, n):
    """One structure in a dialect, as its writers write it."""
    esc = text.replace("&", "&amp;").replace("<", "&lt;") if dialect == "html" else text.replace("&", "\\&").replace("%", "\\%").replace("_", "\\_") if dialect == "tex" else text
    raw = text.replace("&", "&amp;").replace("<", "&lt;") if dialect == "html" else text
    forms = {
        "html": {H: f"<h{n}>{esc}</h{n}>", L: f"<ul><li>{esc}</li></ul>", C: f"<pre><code>{raw}</code></pre>", M: f"<p>so \\({raw}\\) holds</p>", None: f"<p>{esc} <b>bold</b></p>"},
        "markdown": {H: f"{'#' * n} {esc}", L: f"{'-*+'[n % 3]} {esc}", C: f"```\n{raw}\n```", M: f"so \\({raw}\\) holds", None: f"{esc} **bold**"},
        "wiki": {H: f"h{n}. {esc}", L: f"* {esc}", C: f"{{code}}\n{raw}\n{{code}}", M: f"so \\({raw}\\) holds", None: f"{esc} {{{{mono}}}}"},
        "tex": {H: f"\\section{{{esc}}}", L: f"\\begin{{itemize}}\n\\item {esc}\n\\end{{itemize}}", C: f"\\begin{{verbatim}}\n{raw}\n\\end{{verbatim}}", M: f"\\begin{{equation}}\n{raw}\n\\end{{equation}}", None: f"{esc} \\textbf{{bold}}"},
    }
    return forms[dialect][kind]


@pytest.mark.parametrize("dialect", ["html", "markdown", "wiki", "tex"])
@pytest.mark.parametrize("seed", range(15))
def test_what_is_written_is_read(dialect, seed):
    rng = random.Random(seed)
    plan = [(rng.choice([H, L, C, M, None]), " ".join(rng.sample(WORDS, rng.randint(1, 4)))) for _ in range(12)]
    text = "\n\n".join(written(dialect, k, t, rng.randint(1, 6)) for k, t in plan)
    assert sorted(parse_markup(text, dialect == "wiki")) == sorted((k, t) for k, t in plan if k)
