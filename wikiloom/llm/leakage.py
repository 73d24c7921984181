"""Evaluation passages that leak into a corpus, by greedy string tiling.

Words of both sides are numbered; a running Karp-Rabin hash over ``seed`` words finds the places that a document shares
with any item. Consecutive seeds on one diagonal are joined to maximal matches, and the longest are marked first, as
long as their words are unmarked, down to matches of ``seed`` words: the tiles. The share of an item's words under tiles
is its coverage, which does not mind the order of passages.

A pair is reported if its tiles reach a threshold: enough words for a window (always so if the window is there, since its
longest unbroken run, of (window - 1) / 2 words at least, is no longer than the first tile), and then either coverage or
the exact check. That looks for ``window`` running words of which at most one is replaced around each tile, and around
the matches that longer tiles displaced, which reordered or repeated passages may hold.

Items are a stated query set: their index, sorted arrays of 24 bytes a word, goes to the tasks in blocks of a checked
size. With one block, documents are read once and nothing is shuffled or written. With more, the words of the corpus are
numbered once and written to the shared folder, and each block passes over those; a block is released before the next.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wikiloom.llm.canonical import canonical_text
from wikiloom.session import materialize

SEED, WINDOW = 6, 13
#: Characters of item texts whose index is sent to the tasks at once.
BLOCK_CHARS = 16_000_000

_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"<[a-zA-Z/!][^<>]*>|\[([^\[\]\n]*)\]\([^()\s]*\)|\[([^\[\]|\n]*)\|[^\[\]\s]*\]")
_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|s|small|span|strike|strong|sub|sup|tt|u)\b", re.IGNORECASE)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _drop(m: re.Match) -> str:
    if m[0][0] == "[":
        return m[1] if m[1] is not None else m[2]
    return "" if _INLINE.match(m[0]) else " "


def words(text: str | None) -> list[str]:
    """Words of a text in one spelling, without mark-up; none for None."""
    if not text:
        return []
    if "<" in text or "](" in text or "|" in text:
        text = _MARKUP.sub(_drop, text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(canonical_text(text, "Latin").casefold())


def word_hash(word: str) -> int:
    """A word as a number that is the same everywhere; 0 stands for words that no item has."""
    return xxhash.xxh64_intdigest(word) or 1


class Index:
    """Words of a block of items, and the places of each seed in them, as arrays sorted by the seed's hash."""

    def __init__(self, items: list[tuple], seed: int):
        self.seed = seed
        self.ids = [i for i, _ in items]
        texts = [words(text) for _, text in items]
        self.number: dict[str, int] = {}
        for found in texts:
            for w in found:
                self.number.setdefault(w, len(self.number) + 1)
        self.hash = np.array([0, *map(word_hash, self.number)], dtype=np.uint64)
        self.rows = [self.numbers(found) for found in texts]
        hashes = [running(row, seed) for row in self.rows]
        at = np.concatenate([np.empty(0, np.uint64), *hashes])
        order = np.argsort(at, kind="stable")
        self.known = at[order]
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), [len(h) for h in hashes])[order]
        self.place = np.concatenate([np.empty(0, np.int32), *[np.arange(len(h), dtype=np.int32) for h in hashes]])[order]

    def numbers(self, found: list[str]) -> np.ndarray:
        """Words of a document as numbers, 0 for those that no item has."""
        known = self.number
        return self.hash[np.array([known.get(w, 0) for w in found], dtype=np.int64)]

    def shared(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, diagonal, position in the document) of every seed that the document shares, in order."""
        none = np.empty(0, np.int64)
        h = running(doc, self.seed)
        if not len(h) or not len(self.known):
            return none, none, none
        low = np.searchsorted(self.known, h)
        at = np.flatnonzero(self.known[np.minimum(low, len(self.known) - 1)] == h)
        if not len(at):
            return none, none, none
        low = low[at]
        many = np.searchsorted(self.known, h[at], "right") - low
        where = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        pos = np.repeat(at, many)
        item, diagonal = self.item[where], pos - self.place[where]
        order = np.lexsort((pos, diagonal, item))
        return item[order], diagonal[order], pos[order]


def running(numbers: np.ndarray, seed: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``seed`` words."""
    n = len(numbers) - seed + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(seed):
        h = h * _BASE + numbers[k : k + n]
    return h


def matches(doc: np.ndarray, index: Index) -> dict[int, list[tuple[int, int, int]]]:
    """Item number -> maximal common runs (start in document, start in item, length), of at least a seed."""
    item, diagonal, pos = index.shared(doc)
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(pos):
        return out
    first = np.concatenate([[True], (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(pos) != 1)])
    starts = np.nonzero(first)[0]
    ends = np.concatenate([starts[1:], [len(pos)]]) - 1
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        n, i, d = int(item[a]), int(pos[a]), int(diagonal[a])
        length = int(pos[b]) - i + index.seed
        own = index.rows[n][i - d : i - d + length]
        # Seeds are compared by hash; a run is what its words say.
        for start, end in _equal_runs(doc[i : i + length], own, index.seed):
            out.setdefault(n, []).append((i + start, i - d + start, end - start))
    return out


def _equal_runs(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int]]:
    same = a == b
    if same.all():
        return [(0, len(a))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return [(int(x), int(y)) for x, y in edges.reshape(-1, 2) if y - x >= least]


def tiles(found: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: the longest match whose words are unmarked on both sides comes first; what is left of a match that
    overlaps earlier tiles is tried again."""
    if len(found) == 1:
        return found
    marked_doc, marked_item, out = set(), set(), []
    queue = sorted(found, key=lambda m: (-m[2], m[0], m[1]))
    while queue:
        i, j, n = queue.pop(0)
        free = [k for k in range(n) if i + k not in marked_doc and j + k not in marked_item]
        if len(free) == n:
            marked_doc.update(range(i, i + n))
            marked_item.update(range(j, j + n))
            out.append((i, j, n))
            continue
        parts, start = [], None
        for k in [*free, None]:
            if start is not None and (k is None or k != last + 1):
                if last - start + 1 >= least:
                    parts.append((i + start, j + start, last - start + 1))
                start = None
            if k is not None:
                start, last = (k if start is None else start), k
        if parts:
            queue = sorted([*queue, *parts], key=lambda m: (-m[2], m[0], m[1]))
    return out


def best_window(doc: np.ndarray, item: np.ndarray, found: list[tuple[int, int, int]], window: int) -> bool:
    """Whether document and item share ``window`` running words of which at most one is replaced by another."""
    for i, j, n in found:
        if n >= window:
            return True
        if i + n < len(doc) and j + n < len(item):
            r = 0
            while n + 1 + r < window and i + n + 1 + r < len(doc) and j + n + 1 + r < len(item) and doc[i + n + 1 + r] == item[j + n + 1 + r]:
                r += 1
            if n + 1 + r >= window:
                return True
        if i > 0 and j > 0:
            r = 0
            while n + 1 + r < window and i - 2 - r >= 0 and j - 2 - r >= 0 and doc[i - 2 - r] == item[j - 2 - r]:
                r += 1
            if n + 1 + r >= window:
                return True
    return False


def leaks(documents: DataFrame, items: DataFrame, seed: int = SEED, window: int = WINDOW, block_chars: int = BLOCK_CHARS, least: float = 0.0) -> DataFrame:
    """(doc_id, item_id, exact, tiles, longest, coverage) of each document and item whose tiles reach the threshold: the
    pair is exact, or coverage is at least ``least``.

    exact tells whether ``window`` running words with at most one replaced are shared; coverage is the share of the
    item's words under tiles of ``seed`` words. ``documents`` has doc_id and text, ``items`` item_id and text; NULL and
    empty texts hold nothing; items shorter than the window are never exact; repeated rows give repeated results; empty
    tables give no rows; further columns are ignored.
    """
    spark = documents.sparkSession
    texts = items.select("item_id", "text").where("text IS NOT NULL")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    doc_kind, item_kind = documents.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, exact boolean, tiles int, longest int, coverage double"
    docs = documents.select("doc_id", "text").where("text IS NOT NULL")
    search = lambda block: _search(spark.sparkContext.broadcast(Index([tuple(r) for r in block.collect()], seed)), window, least, to_arrow_type(items.schema["item_id"].dataType))
    if blocks == 1:
        return docs.mapInArrow(search(texts)[0], schema)
    docs = materialize(docs.mapInArrow(_number_words, f"doc_id {doc_kind}, words array<bigint>"))
    out = None
    for block in range(blocks):
        run, shared = search(texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block))
        found = materialize(docs.mapInArrow(run, schema))
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _number_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as the hashes of their words."""
    known: dict[str, int] = {}
    for batch in batches:
        rows = []
        for text in batch.column(1):
            found = words(text.as_py())
            for w in found:
                if w not in known:
                    known[w] = word_hash(w)
            rows.append(np.array([known[w] for w in found], dtype=np.uint64).view(np.int64))
            if len(known) > 1_000_000:
                known.clear()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "words"])


def judge(doc: np.ndarray, item: np.ndarray, found: list[tuple[int, int, int]], seed: int, window: int) -> tuple[bool, int, int, float]:
    """(exact, tiles, longest, coverage) of a document and an item with their maximal matches."""
    own = tiles(found, seed)
    covered, longest = sum(t[2] for t in own), max(t[2] for t in own)
    exact = covered >= (window - 1) // 2 and (best_window(doc, item, own, window) or best_window(doc, item, [m for m in found if m not in own], window))
    return exact, len(own), longest, covered / len(item)


def _search(shared, window: int, least: float, item_type: pa.DataType):
    """The search of one block, and the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows, texts = [], batch.column(1)
            numbered = not pa.types.is_string(texts.type) and not pa.types.is_large_string(texts.type)
            for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                doc = text.values.to_numpy().view(np.uint64) if numbered else index.numbers(words(text.as_py()))
                for n, found in matches(doc, index).items():
                    told = judge(doc, index.rows[n], found, index.seed, window)
                    if told[0] or told[3] >= least:
                        rows.append((key, index.ids[n], *told))
            if rows:
                kinds = (batch.schema.field(0).type, item_type, pa.bool_(), pa.int32(), pa.int32(), pa.float64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "exact", "tiles", "longest", "coverage"])

    return run, shared
