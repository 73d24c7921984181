"""Mark-up in text documents to clean text that keeps headings, list items, code blocks and formulas apart.

Documents mix HTML, Markdown, wiki mark-up and LaTeX. Consensus host paths say what of a page is content and how it is
read:

- Every container of a page (the page itself, and the sectioning elements within it) is scored by the text it holds:
  linked text and text of navigation, footers and the like count against it. The container with the greatest score is
  the page's own choice, and its generalised tag-class path is the page's ballot; Spark counts the ballots per host.
- Some line forms mean different things by dialect (``# x`` is a heading in Markdown and a numbered item in wiki
  mark-up). Pages with line forms that one dialect alone has cast a ballot on how their host's shared forms are read.
- Extraction follows the winners: of a page with containers only what stands in the winning path (its own choice, where
  it has no such container), and shared line forms of pages without evidence in the winning reading.

A page is parsed once, where it is read: its structures come out with the path, and if need be the reading, that they
stand under, so what a second extraction would find is selected among them and no body is shuffled. A page without
sectioning elements has one container, the page: nothing of it can lose, and it takes no part in the vote on paths.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.session import materialize

HEADING, ITEM, CODE, FORMULA = "heading", "list_item", "code", "formula"
#: Line forms that one of the two line-based dialects alone has (Java and Python regular expressions).
WIKI_ONLY = r"(?m)^h[1-6]\. |\{(?:code|noformat|color|quote|panel)[:}]|^\|\||\{\{[^{}\n]+\}\}|\[[^\]\[|\n]+\|[^\]\s]+\]|^\*\*+ |^bq\. "
MARKDOWN_ONLY = r"(?m)^ {0,3}(?:```|~~~)|\]\([^)\s]+\)|^(?:=====+|-----+) *$|^#{1,6} .* #+ *$|\*\*[^*\n]+\*\*|^ *[-*+] \[[ xX]\] |^ *\+ |^ *\d+[.)] |^\| *--|~~[^~\n]+~~|^#{3,6} |(?:\A|\n[ \t]*\n)#{2,6} |`[^`\n]+`|(?<![\w_])__[^_\n]+__(?![\w_])"

#: Generalised container paths of the line form that the dialects share: a run of ``# x`` lines, and one on its own.
RUN_PATH, LONE_PATH = r"(?m)^# .*\n# ", r"(?:\A|\n[ \t]*\n)# [^\n]*(?:\n[ \t]*(?:\n|\z)|\z)"

#: Elements that divide a page into containers.
SECTIONS = frozenset({"div", "section", "article", "header", "footer", "nav", "aside", "main", "form", "ac:layout-section", "ac:layout-cell"})
#: Steps of a path that are the furniture of a page: their text counts against what holds it.
FURNITURE = re.compile(r"^(?:nav|footer|aside|form)\b|[.-](?:nav|navigation|navbar|menu|sidebar|footer|breadcrumbs?|banner|cookies?|advert|ads?|share|social|related|toc)(?=[.-]|$)")
#: What a linked character costs a container, against the one that any other adds.
LINK_COST = 2

_SPACE = re.compile(r"\s+")
_BLOCK_TAGS = "h[1-6]|p|ul|ol|li|dl|dt|dd|pre|table|thead|tbody|tfoot|tr|td|th|div|section|article|header|footer|nav|aside|main|blockquote|figure|hr|ac:[\\w-]+|ri:[\\w-]+|html|body|details|summary"
_HTML_START = re.compile(rf"<(?:{_BLOCK_TAGS})(?=[\s>/])", re.IGNORECASE)
_TOKEN = re.compile(r"<!\[CDATA\[(.*?)\]\]>|<!--.*?-->|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.DOTALL)
_BLOCK = re.compile(rf"(?:{_BLOCK_TAGS}|br)$", re.IGNORECASE)
_FLAT = frozenset({"p", "pre", "h1", "h2", "h3", "h4", "h5", "h6"})
_FLAT_STOP = re.compile(r"\n[ \t]*\n|<(?:p|h[1-6]|ul|ol|pre|table|div|ac:structured-macro)(?=[\s>/])", re.IGNORECASE)
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^`\n]*)$")
_MATH_ENV = "equation|align|gather|multline|eqnarray|displaymath|math|flalign"
_TEX_MATH = re.compile(rf"\s*\\begin\{{((?:{_MATH_ENV})\*?)\}}")
_TEX_CODE = re.compile(r"\s*\\begin\{(verbatim\*?|lstlisting|minted|Verbatim)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?")
_TEX_LIST = re.compile(r"\s*\\(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]\n]*\])?")
_TEX_ITEM = re.compile(r"\s*\\item(?![a-zA-Z])\s*(?:\[([^\]\n]*)\])?")
_TEX_HEAD = re.compile(r"\s*\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]\n]*\])?\{")
_WIKI_CODE = re.compile(r"\s*\{(code|noformat)(:[^}\n]*)?\}")
_WIKI_HEAD = re.compile(r"\s*h[1-6]\.\s+(.*)$")
_WIKI_ITEM = re.compile(r"\s*(\*+|#+|-{1,2}|[*#-]{2,6})\s+(.*)$")
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"(\s*)(?:[-*+]|\d{1,9}[.)])(?:[ \t]+(.*))?$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_BOX = re.compile(r"\[[ xX]\](?:\s+|$)")
_ROW = re.compile(r"\s*\|")
_QUOTE = re.compile(r"\s{0,3}>\s?|\s*bq\.\s+")
_INLINE_MATH = re.compile(
    rf"\\begin\{{((?:{_MATH_ENV})\*?)\}}(?P<e>(?:(?!\\begin\{{\1\}}).)*?)\\end\{{\1\}}|\$\$(?P<d>.+?)\$\$|(?<!\\)\\\[(?P<b>(?:(?!(?<!\\)\\\[).)+?)\\\]|(?<!\\)\\\((?P<p>(?:(?!(?<!\\)\\\().)+?)\\\)"
    r"|(?<![\\$\w])\$(?![\s$])(?P<i>(?!\d)[^$\n]*?[^$\s\\]|\d[^$\n]*[\\^_=][^$\n]*?[^$\s\\])\$(?![\d$])",
    re.DOTALL,
)
_IMAGE = re.compile(r"!\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_LINK = re.compile(r"\[([^\[\]]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)")
_WIKI_LINK = re.compile(r"\[([^\[\]|\n]+)\|[^\[\]\n]*\]")
_AUTO = re.compile(r"<(?:https?://|mailto:)([^<>\s]*)>")
_TICKS = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.DOTALL)
_MONO = re.compile(r"\{\{(.+?)\}\}")
_COLOR = re.compile(r"\{color(?::[^}\n]*)?\}|\{anchor:[^}\n]*\}")
_TAG = re.compile(r"</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|s|small|span|strike|strong|sub|sup|tt|u)(?:\s[^<>]*)?/?>|<br\s*/?>", re.IGNORECASE)
#: Styling commands (and links) with their opening brace, labels, escaped characters, and other braces.
_TEX_PART = re.compile(r"(\\(?:emph|text(?:bf|it|tt|sf|sc|rm|up|sl|md|normal)?|underline|uline|sout|url|mbox|hbox|footnotesize)\{|\\href\{[^{}]*\}\{)|(\\label\{[^{}]*\})|\\.|[{}]", re.DOTALL)
_STYLES = [
    re.compile(p, re.DOTALL)
    for p in (r"\*\*\*(?=\S)(.+?)(?<=\S)\*\*\*", r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)", r"~~(?=\S)(.+?)(?<=\S)~~", r"(?<![\w*])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?![\w*])", r"(?<![\w_])_(?=[^\s_])(.+?)(?<=[^\s_])_(?![\w_])")
]
_ESCAPE = re.compile(r"\\([\\`*_{}\[\]()#+\-.!|~$&%<>^\"'])")


def squeeze(text: str) -> str:
    """Each run of white space as one space, none at the ends."""
    return _SPACE.sub(" ", text).strip()


def unwrap_tex(text: str) -> str:
    """Text without LaTeX styling commands, however deeply they nest, in one pass; those never closed stay as written."""
    out, at, stack = [], 0, []
    for m in _TEX_PART.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        if m[2]:
            continue
        if m[1]:
            stack.append(len(out))
            out.append(m[1])
        elif m[0] == "{":
            stack.append(None)
            out.append("{")
        elif m[0] == "}":
            opened = stack.pop() if stack else None
            if opened is None:
                out.append("}")
            else:
                out[opened] = ""
        else:
            out.append(m[0])
    return "".join(out) + text[at:]


class Boxes:
    """Containers of a page by generalised path: characters of their own, those that are linked, and how many they are."""

    def __init__(self) -> None:
        self.own: dict[str, list[int]] = {}

    def add(self, path: str, size: int, linked: bool = False) -> None:
        box = self.own.setdefault(path, [0, 0])
        box[linked] += size

    def scores(self) -> dict[str, int]:
        """Score of each path, that of the page (the empty path) included: what it and all within it add or cost."""
        out = {"": 0}
        for path, (free, linked) in self.own.items():
            steps = path.split(">") if path else []
            worth = -(free + linked) if any(FURNITURE.search(x) for x in steps) else free - LINK_COST * linked
            for n in range(len(steps) + 1):
                above = ">".join(steps[:n])
                out[above] = out.get(above, 0) + worth
        return out

    def best(self) -> str:
        """The path of the greatest score; of equal ones the outermost."""
        return min(self.scores().items(), key=lambda x: (-x[1], x[0].count(">") + bool(x[0]), x[0]))[0]


_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


def step_of(name: str, attributes: str) -> str:
    """A step of a generalised path: the tag, and its classes in order with runs of digits as ``#``."""
    m = _CLASS.search(attributes)
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in (m[1] or m[2] or m[3] or "").split()}) if m else []
    return ".".join([name, *[c.replace(">", "") for c in classes]])


def plain(text: str) -> str:
    """Text of one line form without styling, link targets, tags and escapes."""
    if not any(c in text for c in "*_`~[<\\{&$"):
        return squeeze(text)
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\x00{len(held) - 1}\x00"

    def formula(m: re.Match) -> str:
        return hold(next(m[g] for g in "edbpi" if m[g] is not None))

    text = _TICKS.sub(lambda m: hold(m[2]), text)
    text = _INLINE_MATH.sub(formula, text)
    text = _MONO.sub(r"\1", text)
    text = _COLOR.sub("", text)
    if "\\" in text:
        text = unwrap_tex(text)
    text = _ESCAPE.sub(lambda m: hold(m[1]), text)
    text = _LINK.sub(r"\1", _IMAGE.sub(r"\1", text))
    text = _WIKI_LINK.sub(r"\1", text)
    if "<" in text:
        text = _TAG.sub(lambda m: " " if m[0][:3].lower() == "<br" else "", _AUTO.sub(r"\1", text))
    for style in _STYLES:
        text = style.sub(r"\1", text)
    if "&" in text:
        text = html.unescape(text)
    while "\x00" in text:
        text = re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text)
    return squeeze(text)


def formulas(text: str) -> Iterator[tuple[str, str]]:
    """Formulas within running text."""
    if "$" not in text and "\\" not in text:
        return
    text = _TICKS.sub(" ", text) if "`" in text else text
    for m in _INLINE_MATH.finditer(text):
        found = squeeze(next(m[g] for g in "edbpi" if m[g] is not None))
        if found:
            yield FORMULA, found


def _element_end(text: str, at: int) -> int:
    """End of the HTML element that starts at ``at``; of the text where it is never closed, of the tag where it is void."""
    m = _TOKEN.match(text, at)
    if m is None or m[3] is None:
        return m.end() if m else at + 1
    name = m[3].lower()
    if name in ("hr", "br") or m[4].endswith("/") or m[2]:
        return m.end()
    if name in _FLAT:  # never within itself: ends at the first closing tag, else at the next block or blank line
        end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(text, m.end())
        stop = _FLAT_STOP.search(text, m.end())
        if end and (name == "pre" or not stop or end.start() < stop.start()):
            return end.end()
        return stop.start() if stop else len(text)
    depth, i = 1, m.end()
    while (m := _TOKEN.search(text, i)) is not None:
        i = m.end()
        if m[3] is not None and m[3].lower() == name and not m[4].endswith("/"):
            depth += -1 if m[2] else 1
            if not depth:
                return i
    return len(text)


def parse_html(text: str, boxes: Boxes) -> Iterator[tuple[str, str, str]]:
    """(kind, content, path) of the structures of an HTML fragment, in the order in which they end; ``boxes`` learns what
    its containers hold."""
    buffers: list[tuple[str, list[str], str]] = [("p", [], "")]
    i, pre, macros = 0, 0, []
    within: list[tuple[str, str]] = []  # open sectioning elements and the paths that they end
    links = 0

    def here() -> str:
        return within[-1][1] if within else ""

    def finish(kind: str, parts: list[str], path: str) -> Iterator[tuple[str, str, str]]:
        raw = "".join(parts)
        if kind == CODE:
            if found := squeeze(raw):
                yield CODE, found, path
            return
        yield from ((*x, path) for x in formulas(raw))
        if kind != "p":
            found = squeeze(_INLINE_MATH.sub(lambda m: next(m[g] for g in "edbpi" if m[g] is not None), raw) if "\\" in raw or "$" in raw else raw)
            if found:
                yield kind, found, path

    while True:
        m = _TOKEN.search(text, i)
        chunk = text[i : m.start() if m else len(text)]
        if chunk:
            boxes.add(here(), len(chunk.strip()), links > 0)
            buffers[-1][1].append(html.unescape(chunk) if "&" in chunk else chunk)
        if m is None:
            break
        i = m.end()
        if m[1] is not None:
            if macros and macros[-1] in ("code", "noformat"):
                yield from finish(CODE, [m[1]], here())
            else:
                buffers[-1][1].append(m[1])
            continue
        if m[3] is None:
            continue
        closing, name = bool(m[2]), m[3].lower()
        void = m[4].endswith("/")
        if name == "ac:structured-macro":
            if closing:
                if macros:
                    macros.pop()
            elif not void:
                kind = re.search(r"ac:name\s*=\s*[\"']([^\"']*)", m[4])
                macros.append(kind[1].strip().lower() if kind else "")
            continue
        if name == "ac:parameter":
            if closing:
                if len(buffers) > 1 and buffers[-1][0] == "skip":
                    buffers.pop()
            elif not void:
                buffers.append(("skip", [], here()))
            continue
        if name == "pre":
            if closing:
                if pre and any(b[0] == CODE for b in buffers):
                    pre -= 1
                    while buffers[-1][0] != CODE:
                        buffers.pop()
                    yield from finish(*buffers.pop())
            elif not void:
                pre += 1
                buffers.append((CODE, [], here()))
            continue
        if pre:
            if name == "br":
                buffers[-1][1].append("\n")
            continue
        kind = ITEM if name == "li" else HEADING if re.fullmatch("h[1-6]", name) else None
        if kind:
            if closing:
                if any(b[0] == kind for b in buffers):
                    while True:
                        own = buffers.pop()
                        yield from finish(*own)
                        if own[0] == kind:
                            break
                    buffers[-1][1].append(" ")
            elif not void:
                buffers[-1][1].append(" ")
                buffers.append((kind, [], here()))
        elif _BLOCK.match(name):
            buffers[-1][1].append(" ")
            if name in SECTIONS and not void:
                if not closing:
                    within.append((name, ">".join(filter(None, (here(), step_of(name, m[4]))))))
                elif any(n == name for n, _ in within):
                    while within.pop()[0] != name:
                        pass
            if len(buffers) == 1 and name != "br":
                yield from finish(*buffers[0])
                buffers[0] = ("p", [], here())
        elif name == "a":
            links = max(0, links + (-1 if closing else 0 if void else 1))
    while buffers:
        yield from finish(*buffers.pop())


def parse_markup(text: str | None, wiki: bool) -> Iterator[tuple[str, str]]:
    """(kind, content) of all headings, list items, code blocks and formulas of a text, wherever they stand."""
    return ((kind, content) for kind, content, _ in walk_markup(text, wiki, Boxes()))


def walk_markup(text: str | None, wiki: bool, boxes: Boxes) -> Iterator[tuple[str, str, str]]:
    """(kind, content, path) of all headings, list items, code blocks and formulas of a text in any mix of the dialects.

    ``wiki`` says how to read the line forms that Markdown and wiki mark-up share; path is that of the innermost
    container. ``boxes`` learns what each container holds.
    """
    if not text:
        return
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    n, at = len(text), 0
    para: list[str] = []
    item: list[str] | None = None
    tex_items: list[list[str] | None] = []
    blank = True
    outside = n

    def top(found: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        return ((*x, "") for x in found)

    def flush() -> Iterator[tuple[str, str, str]]:
        nonlocal item
        if item is not None:
            raw, item = "\n".join(item), None
            yield from top(formulas(raw))
            raw = _BOX.sub("", raw, count=1) if _BOX.match(raw) else raw
            if found := plain(raw):
                yield ITEM, found, ""
        if para:
            raw = "\n".join(para)
            para.clear()
            yield from top(formulas(raw))

    def heading(raw: str) -> Iterator[tuple[str, str, str]]:
        yield from top(formulas(raw))
        if found := plain(raw):
            yield HEADING, found, ""

    def tex_flush() -> Iterator[tuple[str, str, str]]:
        if tex_items and tex_items[-1] is not None:
            raw, tex_items[-1] = "\n".join(tex_items[-1]), None
            yield from top(formulas(raw))
            if found := plain(raw):
                yield ITEM, found, ""

    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        line = text[at:end]
        bare = line.strip()
        if not bare:
            if item is None:
                yield from flush()
            blank, at = True, end + 1
            continue
        first, was_blank, blank = bare[0], blank, False
        if first in "`~" and (m := _FENCE.match(line)):
            yield from flush()
            close = re.compile(rf"^[ \t]*{m[1][0]}{{{len(m[1])},}}[ \t]*$", re.MULTILINE)
            c = close.search(text, end + 1)
            if found := squeeze(text[end + 1 : c.start() if c else n]):
                yield CODE, found, ""
            at = (c.end() if c else n) + 1
            continue
        if first == "{" and (m := _WIKI_CODE.match(line)):
            c = text.find("{" + m[1] + "}", at + m.end())
            if c >= 0:
                yield from flush()
                if found := squeeze(text[at + m.end() : c]):
                    yield CODE, found, ""
                at = c + len(m[1]) + 2
                continue
        if first == "\\":
            if m := _TEX_CODE.match(line):
                c = text.find("\\end{" + m[1] + "}", at + m.end())
                yield from flush()
                if found := squeeze(text[at + m.end() : c if c >= 0 else n]):
                    yield CODE, found, ""
                at = n if c < 0 else c + len(m[1]) + 6
                continue
            if m := _TEX_MATH.match(line):
                c = text.find("\\end{" + m[1] + "}", at + m.end())
                if c >= 0:
                    yield from flush()
                    if found := squeeze(text[at + m.end() : c]):
                        yield FORMULA, found, ""
                    at = c + len(m[1]) + 6
                    continue
            if m := _TEX_LIST.match(line):
                if m[1] == "begin":
                    yield from flush()
                    tex_items.append(None)
                else:
                    yield from tex_flush()
                    if tex_items:
                        tex_items.pop()
                at += m.end()
                continue
            if tex_items and (m := _TEX_ITEM.match(line)):
                yield from tex_flush()
                tex_items[-1] = [((m[1] + " ") if m[1] else "") + line[m.end() :]]
                at = end + 1
                continue
            if m := _TEX_HEAD.match(line):
                depth, i = 1, at + m.end()
                while i < n and depth:
                    depth += {"{": 1, "}": -1}.get(text[i], 0) if text[i - 1] != "\\" else 0
                    i += 1
                yield from flush()
                yield from heading(text[at + m.end() : i - 1])
                at = i
                continue
            if bare.startswith("\\[") and (c := text.find("\\]", at)) >= 0:
                yield from flush()
                if found := squeeze(text[text.index("\\[", at) + 2 : c]):
                    yield FORMULA, found, ""
                at = c + 2
                continue
        if tex_items and tex_items[-1] is not None:
            tex_items[-1].append(line)
            at = end + 1
            continue
        if bare.startswith("$$"):
            o = text.index("$$", at)
            c = text.find("$$", o + 2)
            if c >= 0:
                yield from flush()
                if found := squeeze(text[o + 2 : c]):
                    yield FORMULA, found, ""
                at = c + 2
                continue
        if first == "<" and (m := _HTML_START.match(bare)):
            yield from flush()
            at += len(line) - len(line.lstrip())
            stop = _element_end(text, at)
            yield from parse_html(text[at:stop], boxes)
            outside -= stop - at
            at = stop
            blank = True
            continue
        if was_blank and item is None and not para and (line[:4] == "    " or line[0] == "\t"):
            stop, last = end, end
            while stop < n:
                nxt = text.find("\n", stop + 1)
                nxt = n if nxt < 0 else nxt
                row = text[stop + 1 : nxt]
                if row.strip() and row[:4] != "    " and row[:1] != "\t":
                    break
                last = nxt if row.strip() else last
                stop = nxt
            if found := squeeze(text[at:last]):
                yield CODE, found, ""
            at = last + 1
            continue
        if m := _WIKI_HEAD.match(line):
            yield from flush()
            yield from heading(m[1])
            at = end + 1
            continue
        if wiki:
            if first in "*#-" and (m := _WIKI_ITEM.match(line)):
                yield from flush()
                item = [m[2]]
                at = end + 1
                continue
        else:
            if first == "#" and (m := _ATX.match(line)):
                yield from flush()
                yield from heading(m[1] or "")
                at = end + 1
                continue
            if para and item is None and first in "=-" and _SETEXT.match(line):
                raw = "\n".join(para)
                para.clear()
                yield from heading(raw)
                at = end + 1
                continue
        if _RULE.match(line):
            yield from flush()
            at = end + 1
            continue
        if m := _ITEM.match(line):
            yield from flush()
            item = [m[2] or ""]
            at = end + 1
            continue
        if first == "|" and _ROW.match(line):
            yield from flush()
            yield from top(formulas(line))
            at = end + 1
            continue
        if (first == ">" or line.startswith("bq.")) and (m := _QUOTE.match(line)):
            line = line[m.end() :]
        if item is not None and was_blank and line[:1] not in " \t":
            yield from flush()
        (item if item is not None else para).append(line)
        at = end + 1
    while tex_items:
        yield from tex_flush()
        tex_items.pop()
    yield from flush()
    boxes.add("", max(0, outside))


def evidence(text: Column) -> dict[str, Column]:
    """wiki_score and markdown_score, the line forms that only the one or the other dialect has, and form, the
    generalised path of the line form that both have (JVM-side)."""
    form = F.when(text.rlike(RUN_PATH), "#+").when(text.rlike(LONE_PATH), "#").otherwise("")
    return {"wiki_score": F.regexp_count(text, F.lit(WIKI_ONLY)), "markdown_score": F.regexp_count(text, F.lit(MARKDOWN_ONLY)), "form": form}


#: Rows of the parse. row: ``found`` (a structure), ``box`` (a container; kind ``best`` for the page's own choice) or
#: ``form`` (a ballot on a shared line form). open: the page depends on a vote. reading: empty where it is settled.
PARSED = "row string, open boolean, reading string, form string, path string, kind string, content string"
_WIKI, _MARKDOWN = "wiki", "markdown"


def parse_page(text: str, wiki_score: int, markdown_score: int, form: str) -> Iterator[tuple]:
    """Rows of PARSED of one page, each once."""
    undecided = wiki_score == markdown_score and form != ""
    readings = (_WIKI, _MARKDOWN) if undecided else (_WIKI if wiki_score > markdown_score else _MARKDOWN,)
    boxes = Boxes()
    found = {r: dict.fromkeys(walk_markup(text, r == _WIKI, boxes if n == 0 else Boxes())) for n, r in enumerate(readings)}
    divided = any(path for path in boxes.own)
    open_ = undecided or divided
    for reading, rows in found.items():
        for kind, content, path in rows:
            yield "found", open_, reading if undecided else "", form if undecided else "", path, kind, content
    if divided:
        best = boxes.best()
        for path in boxes.scores():
            yield "box", open_, "", "", path, "best" if path == best else "other", ""
    if form and not undecided:
        yield "form", open_, readings[0], form, "", "", ""


def parsed(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """(*columns, *PARSED) of each text, worked out where the rows are; NULL and empty texts give no rows."""
    base = df.select(*columns, F.col(text).alias("_text")).where("_text IS NOT NULL AND _text <> ''")
    base = base.withColumns(evidence(F.col("_text")))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    names = [x.split()[0] for x in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for n, (body, *scores) in enumerate(zip(batch.column("_text"), *(batch.column(c).to_pylist() for c in ("wiki_score", "markdown_score", "form")), strict=True)):
                new = list(parse_page(body.as_py(), *scores))
                at += [n] * len(new)
                rows += new
            if rows:
                keys = batch.select(columns).take(pa.array(at))
                own = [pa.array(c, pa.bool_() if n == "open" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([*keys.columns, *own], names=[*columns, *names])

    return base.mapInArrow(run, f"{kinds}, {PARSED}")


def vote(rows: DataFrame, host: str) -> tuple[DataFrame, DataFrame]:
    """Winners per host: (host, form, reading) and (host, path).

    A reading wins by more pages, Markdown on a tie; a path by more pages, then the outermost, then by its name. Ballots
    combine map-side to a row per host and candidate; the second step sees only those.
    """
    forms = rows.where("row = 'form'").groupBy(host, "form").agg(F.sum(F.when(F.col("reading") == _WIKI, 1).otherwise(-1)).alias("n"))
    readings = forms.select(host, "form", F.when(F.col("n") > 0, _WIKI).otherwise(_MARKDOWN).alias("winner"))
    ballots = rows.where("row = 'box' AND kind = 'best'").groupBy(host, "path").agg(F.count("*").alias("n"))
    rank = F.struct(-F.col("n"), F.size(F.filter(F.split("path", ">"), lambda x: x != "")), F.col("path"))
    return readings, ballots.groupBy(host).agg(F.min_by("path", rank).alias("winner"))


#: Parts that a host's winners and pages are split into, so that a host with a third of all pages is no hot key.
SALTS = 16


def _meet(rows: DataFrame, winners: DataFrame, on: list[str], key: str) -> DataFrame:
    """Rows with the winner of their host; a host is spread over SALTS parts."""
    salted = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], "left").drop("_salt")


def structures(df: DataFrame, key: str, host: str, text: str, order: str | None = None, vote_paths: bool = True) -> DataFrame:
    """(key, kind, content) of every heading, list item, code block and formula in the content of a page, in plain text.

    With ``order`` only the rows of a key that are greatest in it count (NULL is the least), those without a text too.
    Of a page with containers what stands within its host's winning path counts, or within its own choice if it has no
    such container; with ``vote_paths`` off every container counts. Pages without evidence of their dialect read their
    shared line form as most pages of their host do; where no page of the host can tell, a run of ``# x`` lines is a list
    and a line on its own a heading. Each row comes once. NULL and empty texts give no rows; NULL hosts are one host; NULL
    keys are one page; an empty table gives no rows; further columns are ignored.
    """
    named = df.select(F.col(key), F.coalesce(F.col(host), F.lit("")).alias("_host"), F.col(text).alias("_body"), *([F.col(order).alias("_order")] if order else []))
    rows = parsed(named, [key, "_host", *(["_order"] if order else [])], "_body")
    if order:
        last = named.groupBy(F.col(key).alias("_key")).agg(F.max("_order").alias("_last"))
        same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_order").eqNullSafe(F.col("_last"))
        rows = rows.join(last, same, "left_semi").drop("_order")
    rows = materialize(rows)
    readings, paths = vote(rows, "_host")
    found = rows.where("row = 'found'")
    settled = found.where("NOT open").select(key, "kind", "content")
    asking = _meet(found.where("open"), readings, ["_host", "form"], key)
    own = F.coalesce("winner", F.when(F.col("form") == "#+", _WIKI).otherwise(_MARKDOWN))
    asking = asking.where((F.col("reading") == "") | (F.col("reading") == own)).drop("winner")
    if vote_paths:
        boxes = _meet(rows.where("row = 'box'"), paths, ["_host"], key)
        choice = boxes.groupBy(F.col(key).alias("_page"), "_host").agg(
            F.coalesce(F.max(F.when(F.col("path") == F.col("winner"), F.col("path"))), F.max(F.when(F.col("kind") == "best", F.col("path")))).alias("choice")
        )
        page = F.col(key).eqNullSafe(F.col("_page")) & (asking["_host"] == choice["_host"])
        inside = F.col("choice").isNull() | (F.col("choice") == "") | (F.col("path") == F.col("choice")) | F.startswith("path", F.concat("choice", F.lit(">")))
        asking = asking.join(choice, page, "left").where(inside)
    return settled.unionByName(asking.select(key, "kind", "content")).distinct()
