"""ADF documents to Markdown.

A recursive tree of unknown depth cannot be a column type, so this is the one step that leaves the JVM: a pandas UDF
over Arrow batches, pure per document. ``BLOCKS`` (node type -> Markdown) and ``CELLS`` (node type -> HTML inside a
table cell) may be extended by the caller before the UDF is made: what it then holds goes to the workers with it.

Documents nest as deeply as they like: text is parsed with a stack of its own where it must be, and the limit on nested
Python calls, which take no C stack, follows the depth of the document.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, functions as F

from wikiloom.operators.nested import parse_json

#: The order in which marks are applied, innermost first; all others come last and change nothing.
MARK_ORDER = {"code": 0, "subsup": 1, "link": 2, "strong": 3, "em": 4, "strike": 5, "underline": 6, "textColor": 7}
_LAST_MARK = 99
TICKET_URL = "https://jira.atlassian.net/browse/"


class BadDocument(ValueError):
    """The text is not a document: not JSON, or a field has the wrong type."""


@dataclass
class Counter:
    n: int = 0


@dataclass(frozen=True)
class Place:
    """Where in nested lists a node stands."""

    ordered: bool = False
    depth: int = 0
    count: Counter = field(default_factory=Counter)


class Out:
    """Text under construction, which knows how it ends."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.tail = ""

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.tail = (self.tail + text)[-2:]

    def gap(self) -> None:
        """A blank line, but at the start."""
        if self.parts and self.tail != "\n\n":
            self.add("\n" if self.tail.endswith("\n") else "\n\n")

    def __str__(self) -> str:
        return "".join(self.parts)


Renderer = Callable[[dict, Place, Out], None]
BLOCKS: dict[str, Renderer] = {}
CELLS: dict[str, tuple[bool, Callable[[dict, Place], str]]] = {}


def block(*types: str) -> Callable[[Renderer], Renderer]:
    def register(f: Renderer) -> Renderer:
        BLOCKS.update(dict.fromkeys(types, f))
        return f

    return register


def cell(*types: str, complex_: bool = True):
    """Register HTML for a node within a cell; ``complex_`` nodes force the whole table into HTML."""

    def register(f):
        CELLS.update(dict.fromkeys(types, (complex_, f)))
        return f

    return register


def attr_text(node: dict, key: str, fallback: str = "") -> str:
    """A text attribute; the fallback where it is missing or of another type."""
    value = (node.get("attrs") or {}).get(key)
    return value if isinstance(value, str) else fallback


def attr_int(node: dict, key: str, fallback: int) -> int:
    value = (node.get("attrs") or {}).get(key)
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else fallback


def walk(node: dict, place: Place, out: Out) -> None:
    """Render a node; nodes of unknown type pass their children on."""
    if (own := BLOCKS.get(node.get("type", ""))) is not None:
        own(node, place, out)
    else:
        walk_children(node, place, out)


def walk_children(node: dict, place: Place, out: Out) -> None:
    for child in node.get("content") or ():
        walk(child, place, out)


def inside(node: dict, place: Place) -> str:
    out = Out()
    walk_children(node, place, out)
    return str(out)


def style(text: str, mark: dict) -> str:
    """Text with one mark."""
    match mark.get("type"):
        case "code":
            return f"`{text}`"
        case "subsup":
            tag = attr_text(mark, "type")
            return f"<{tag}>{text}</{tag}>" if tag in ("sub", "sup") else text
        case "link":
            href = attr_text(mark, "href")
            return f"[{text}]({href})" if href else text
        case "strong":
            return f"**{text}**"
        case "em":
            return f"_{text}_"
        case "strike":
            return f"~~{text}~~"
        case "underline":
            return f"<u>{text}</u>"
    return text


@block("text")
def _text(node, place, out):
    text = node.get("text") or ""
    for mark in sorted(node.get("marks") or (), key=lambda m: MARK_ORDER.get(m.get("type"), _LAST_MARK)):
        text = style(text, mark)
    out.add(text)


@block("paragraph")
def _paragraph(node, place, out):
    text = inside(node, place)
    if text.strip():
        out.gap()
        out.add(text + "\n\n")


@block("heading")
def _heading(node, place, out):
    out.gap()
    out.add("#" * min(max(attr_int(node, "level", 1), 1), 6) + " ")
    walk_children(node, place, out)
    out.add("\n\n")


@block("bulletList", "taskList", "decisionList")
def _bullets(node, place, out):
    walk_children(node, replace(place, ordered=False, depth=place.depth + 1), out)
    out.add("\n")


@block("orderedList")
def _numbers(node, place, out):
    walk_children(node, Place(True, place.depth + 1), out)
    out.add("\n")


@block("listItem")
def _item(node, place, out):
    margin = "  " * max(place.depth - 1, 0)
    if place.ordered:
        place.count.n += 1
    prefix = f"{place.count.n}. " if place.ordered else "- "
    first, *rest = inside(node, place).rstrip("\n").split("\n")
    out.add(f"{margin}{prefix}{first}\n")
    for line in rest:
        out.add(f"{margin}{' ' * len(prefix)}{line}\n" if line.strip() else "\n")


def _checked(state: str) -> Renderer:
    def render(node, place, out):
        mark = "x" if attr_text(node, "state") == state else " "
        body = inside(node, place).rstrip("\n")
        out.add(f"{'  ' * max(place.depth - 1, 0)}- [{mark}] {body}\n")

    return render


BLOCKS |= {"taskItem": _checked("DONE"), "decisionItem": _checked("DECIDED")}


@block("caption")
def _caption(node, place, out):
    if text := inside(node, place).strip():
        out.add(f"*{text}*\n")


@block("codeBlock")
def _code(node, place, out):
    body = "".join(c.get("text") or "" for c in node.get("content") or ())
    out.add(f"```{attr_text(node, 'language')}\n{body}\n```\n\n")


def _quoted(text: str, first: str) -> str:
    lines = text.rstrip("\n").split("\n")
    return "".join(f"{first if i == 0 else '> '}{line}\n" for i, line in enumerate(lines)) + "\n"


@block("blockquote")
def _quote(node, place, out):
    out.add(_quoted(inside(node, place), "> "))


@block("panel")
def _panel(node, place, out):
    kind = attr_text(node, "panelType")
    out.add(_quoted(inside(node, place), f"> **{kind[:1].upper()}{kind[1:]}:** " if kind else "> "))


@block("rule")
def _rule(node, place, out):
    out.add("---\n\n")


@block("expand", "nestedExpand")
def _expand(node, place, out):
    if title := attr_text(node, "title"):
        out.add(f"**{title}**\n\n")
    walk_children(node, place, out)


@block("layoutSection", "layoutColumn")
def _pass(node, place, out):
    walk_children(node, place, out)


@block("mediaSingle", "mediaGroup")
def _media_block(node, place, out):
    out.gap()
    walk_children(node, place, out)
    out.gap()


@block("media", "mediaInline")
def _media(node, place, out):
    if name := attr_text(node, "id"):
        out.add(f"![{attr_text(node, 'alt', name)}](attachment://{name})")


@block("hardBreak")
def _break(node, place, out):
    out.add("\n")


@block("mention")
def _mention(node, place, out):
    out.add(attr_text(node, "text"))


@block("emoji")
def _emoji(node, place, out):
    out.add(attr_text(node, "text") or attr_text(node, "shortName"))


@block("date")
def _date(node, place, out):
    stamp = attr_text(node, "timestamp")
    ms = int(re.match(r"[0-9]*", stamp)[0] or 0)
    try:
        out.add(long_date(datetime.fromtimestamp(ms / 1000, timezone.utc)) if ms > 0 else stamp)
    except (OverflowError, ValueError, OSError):
        out.add(stamp)


def long_date(at: datetime) -> str:
    return f"{at.day} {at:%B} {at.year}"


@block("inlineCard")
def _card(node, place, out):
    if url := attr_text(node, "url"):
        out.add(f"[{url}]({url})")


@block("blockCard")
def _block_card(node, place, out):
    if url := attr_text(node, "url"):
        out.add(f"\n[{url}]({url})\n\n")


@block("status")
def _status(node, place, out):
    if text := attr_text(node, "text"):
        out.add(f"**{text}**")


def macro_params(node: dict) -> dict[str, str]:
    """Parameters of a macro: plain texts, or objects whose ``value`` is one."""
    attrs = node.get("attrs") or {}
    for key in ("macroParams", "parameters"):
        if isinstance(params := attrs.get(key), dict):
            flat = {k: v.get("value") if isinstance(v, dict) else v for k, v in params.items()}
            return {k: v for k, v in flat.items() if isinstance(v, str)}
    return {}


@block("extension", "inlineExtension", "bodiedExtension")
def _extension(node, place, out):
    if attr_text(node, "extensionKey") != "jira":
        walk_children(node, place, out)
        return
    params = macro_params(node)
    if ticket := params.get("key") or params.get("issueKey"):
        out.add(f"[{ticket}]({TICKET_URL}{ticket})")


def _any_complex(node: dict) -> bool:
    todo = list(node.get("content") or ())
    while todo:
        child = todo.pop()
        if CELLS.get(child.get("type", ""), (False, None))[0]:
            return True
        todo += child.get("content") or ()
    return False


@block("table")
def _table(node, place, out):
    rows = [r.get("content") or [] for r in node.get("content") or ()]
    spans = any(attr_int(c, k, 1) > 1 for r in rows for c in r for k in ("colspan", "rowspan"))
    if spans or any(_any_complex(c) for r in rows for c in r):
        out.add(_html_table(rows, place) + "\n")
        return
    grid = [[inside(c, place).strip().replace("\n", " ").replace("|", "\\|") for c in r] for r in rows]
    width = max(map(len, grid), default=0)
    lines = ["|" + "".join(f" {x} |" for x in r + [""] * (width - len(r))) for r in grid]
    if lines:
        lines.insert(1, "|" + " --- |" * width)
    out.add("".join(f"{line}\n" for line in lines) + "\n")


def _html_table(rows: list[list[dict]], place: Place) -> str:
    lines = []
    for row in rows:
        cells = []
        for c in row:
            tag = "th" if c.get("type") == "tableHeader" else "td"
            spans = "".join(f' {k}="{n}"' for k in ("colspan", "rowspan") if (n := attr_int(c, k, 1)) > 1)
            cells.append(f"<{tag}{spans}>{cell_html(c, place).strip()}</{tag}>")
        lines.append(f"<tr>{''.join(cells)}</tr>\n")
    return f"<table>\n{''.join(lines)}</table>"


def cell_html(node: dict, place: Place) -> str:
    """Children of a node as HTML; a child without HTML of its own gives what its children give in Markdown."""
    parts = []
    for child in node.get("content") or ():
        _, own = CELLS.get(child.get("type", ""), (False, None))
        parts.append(own(child, place) if own else inside(child, place))
    return "".join(parts)


@cell("paragraph", complex_=False)
def _cell_paragraph(node, place):
    text = inside(node, place).strip()
    return f"<p>{text}</p>" if text else ""


@cell("heading")
def _cell_heading(node, place):
    level = min(max(attr_int(node, "level", 1), 1), 6)
    return f"<h{level}>{inside(node, place).strip()}</h{level}>"


@cell("codeBlock")
def _cell_code(node, place):
    return f"<pre><code>{inside(node, place).strip()}</code></pre>"


def _cell_list(tag: str, state: str | None = None):
    def render(node, place):
        items = []
        for item in node.get("content") or ():
            box = "" if state is None else "[x] " if attr_text(item, "state") == state else "[ ] "
            items.append(f"<li>{box}{cell_html(item, place).strip()}</li>")
        return f"<{tag}>{''.join(items)}</{tag}>"

    return render


for _type, _own in {"bulletList": _cell_list("ul"), "orderedList": _cell_list("ol"), "taskList": _cell_list("ul", "DONE"), "decisionList": _cell_list("ul", "DECIDED")}.items():
    cell(_type)(_own)


_BLOCKS, _CELLS = dict(BLOCKS), dict(CELLS)

_HEADING = re.compile(r"#{1,6} ")


def tidy(markdown: str) -> str:
    """Blank lines around headings, rules and tables, and at most one in a row; fenced code keeps its lines."""
    lines: list[str] = []
    fenced = table = False

    def part() -> None:
        if lines and lines[-1]:
            lines.append("")

    for line in re.sub(r"\n{3,}", "\n\n", markdown).split("\n"):
        bare = line.strip()
        fence = bare.startswith("```")
        if fenced and not fence:
            lines.append(line)
            continue
        row = not fence and bare[:1] == "|" and bare[-1:] == "|"
        alone = bare in ("---", "***", "___") or _HEADING.match(bare) is not None
        if (table and bare and not row) or (row and not table) or (alone and not fence):
            part()
        if bare:
            table = row
        if fence:
            fenced = not fenced
            lines.append(bare)
        elif row:
            lines.append(bare)
        elif alone:
            lines += [bare, ""]
        elif bare:
            lines.append(line)
        else:
            part()
    return "\n".join(lines)


_KINDS = {"type": str, "attrs": dict, "content": list, "text": str, "marks": list}
#: Python calls per level of nesting, at most, and those that surround them.
_CALLS, _AROUND = 8, 2_000


def _check(node) -> int:
    """Complete a tree in place and give its depth; :class:`BadDocument` where a field has the wrong type."""
    todo, deepest = [(node, 1)], 0
    while todo:
        at, depth = todo.pop()
        deepest = max(deepest, depth)
        if not isinstance(at, dict):
            raise BadDocument("a node is not an object")
        for k, kind in _KINDS.items():
            if at.get(k) is None:
                at.pop(k, None)
            elif not isinstance(at[k], kind):
                raise BadDocument(f"{k} is not {kind.__name__}")
        at["content"] = [{} if c is None else c for c in at.get("content", ())]
        at["marks"] = [{} if m is None else m for m in at.get("marks", ())]
        for m in at["marks"]:
            if not isinstance(m, dict) or not isinstance(m.get("type") or "", str):
                raise BadDocument("a mark is not an object")
        todo += [(c, depth + 1) for c in at["content"]]
    return deepest


@contextmanager
def room_for(depth: int) -> Iterator[None]:
    """Let calls nest as deeply as a document does."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, depth * _CALLS + _AROUND))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def render_document(adf: str | None) -> str:
    """Markdown of a document; :class:`BadDocument` where the text is none. JSON null is an empty document."""
    document = parse_json(adf)
    if document is None:
        if (adf or "").strip().lstrip("\ufeff") != "null":
            raise BadDocument("not JSON")
        document = {}
    if not isinstance(document, dict):
        raise BadDocument("not an object")
    root = {"content": document.get("content")}
    with room_for(_check(root)):
        out = Out()
        for child in root["content"]:
            walk(child, Place(), out)
    return tidy(str(out))


def try_render(adf: str | None) -> str | None:
    """Markdown, or None where the text is no document."""
    try:
        return render_document(adf)
    except BadDocument:
        return None


def has_title(markdown: str, title: str) -> bool:
    """Whether the first line is ``# title``, whatever its case."""
    first = markdown.lstrip("\ufeff").split("\n", 1)[0].strip()
    return first.startswith("# ") and first[2:].strip().lower() == title.strip().lower()


@contextmanager
def registered(blocks: dict[str, Renderer], cells: dict) -> Iterator[None]:
    """Use further renderers for a while, as the caller of the UDF had them."""
    saved = dict(BLOCKS), dict(CELLS)
    BLOCKS.update(blocks)
    CELLS.update(cells)
    try:
        yield
    finally:
        for own, old in zip((BLOCKS, CELLS), saved, strict=True):
            own.clear()
            own.update(old)


def extensions() -> tuple[dict, dict]:
    """Renderers that were registered besides, or instead of, those of this module."""
    return tuple({k: v for k, v in now.items() if built_in.get(k) is not v} for now, built_in in ((BLOCKS, _BLOCKS), (CELLS, _CELLS)))


def rendered(adf: Column) -> Column:
    """Column of Markdown; NULL where the document is broken, empty or NULL. Registered extensions travel along."""
    blocks, cells = extensions()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        with registered(blocks, cells):
            return pd.Series([try_render(x) for x in s], dtype=object)

    return run(adf)


def with_title(markdown: Column, title: Column) -> Column:
    """The title as a first heading, unless the text starts with it (JVM-side)."""
    first = F.trim(F.split(F.regexp_replace(markdown, "^\ufeff", ""), "\n", 2)[0])
    there = first.startswith("# ") & (F.lower(F.trim(F.substring(first, 3, 2**31 - 1))) == F.lower(F.trim(title)))
    return F.when(there, markdown).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), markdown))
