"""Oversized texts in pieces that end at natural boundaries.

Recursive bisection: a text is cut at the strongest boundary near its midpoint, and halves that still exceed the limit
less the overlap are cut again; overlaps are attached last. Only a stretch without any white space that is itself over
the limit is cut by force, between characters that do not combine.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LIMIT, OVERLAP = 3000, 200
#: Characters of text after which the pieces cut so far are handed on.
_BATCH_CHARS = 4_000_000
#: Boundaries from the strongest to the weakest; a cut comes at the end of the match.
BOUNDARIES = [re.compile(p) for p in (r"\n(?=#{1,6} |h[1-6]\. |<[hH][1-6]\b|\\(?:sub)*section)", r"\n[ \t]*\n+", r"\n", r"[.!?。！？][\"')\]]*(?:\s+|(?<=[。！？]))", r"[,;:]\s+", r"\s+")]


def strongest_cut(text: str, a: int, b: int) -> int | None:
    """Where to cut text[a:b]: the boundary of the strongest kind in the middle half, nearest to the midpoint; failing
    that, the white space nearest to the midpoint; None where there is none."""
    mid, quarter = (a + b) // 2, (b - a) // 4
    for kind in BOUNDARIES:
        ends = [m.end() for m in kind.finditer(text, mid - quarter, mid + quarter)]
        ends = [e for e in ends if a < e < b]
        if ends:
            return min(ends, key=lambda e: (abs(e - mid), e))
    after = re.compile(r"\s").search(text, mid, b)
    up = None if after is None else after.start() if a < after.start() else after.end() if after.end() < b else None
    down = None
    if text[mid - 1].isspace():
        down = mid
    elif (words := text[a:mid].rsplit(None, 1)) and (len(words) == 2 or text[a].isspace()):
        down = mid - len(words[-1])
    known = [x for x in (up, down) if x is not None]
    return min(known, key=lambda x: (abs(x - mid), x)) if known else None


def forced_cut(text: str, a: int, b: int) -> int:
    """The midpoint, moved back so that a combining character or joiner stays with its base."""
    mid = (a + b) // 2
    i = mid
    while i > a + 1 and (unicodedata.combining(text[i]) or text[i] in "‍️" or text[i - 1] == "‍"):
        i -= 1
    return i if i > a + 1 else mid


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """(from, start, end, forced) of each piece: text[from:end], whose text[from:start] repeats the end of the one
    before; forced tells that the piece starts at a forced cut. A text within the limit is one piece."""
    if len(text) <= limit:
        return [(0, 0, len(text), False)]
    done, stack = [], [(0, len(text), False)]
    while stack:
        a, b, forced = stack.pop()
        if b - a <= limit - overlap:
            done.append((a, b, forced))
            continue
        cut, by_force = strongest_cut(text, a, b), False
        if cut is None:
            if b - a <= limit:  # whole, with less overlap
                done.append((a, b, forced))
                continue
            cut, by_force = forced_cut(text, a, b), True
        stack.append((cut, b, by_force))
        stack.append((a, cut, forced))
    out = []
    for n, (a, b, forced) in enumerate(done):
        begin = a
        if n:
            least = max(done[n - 1][0], a - min(overlap, limit - (b - a)))
            begin = least
            if least > 0 and not text[least - 1].isspace():  # start with a whole word
                m = re.compile(r"\s").search(text, least, a)
                begin = m.end() if m else (least if forced else a)
        out.append((begin, a, b, forced))
    return out


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, texts: bool = True) -> DataFrame:
    """(key, piece, start, overlap, forced, text) of every text, in order.

    ``start`` is where the piece's own part begins, counted in code points; its first ``overlap`` characters repeat the
    end of the piece before, so that the own parts put together give the text. ``forced`` tells that the cut before the
    piece lies within a stretch without white space that is over the limit. NULL texts give no rows, an empty text one
    empty piece; keys may repeat, be NULL or be structs; further columns are ignored. Rows are worked on where they are.
    Without ``texts`` the texts of the pieces are left out.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at, cuts, own = batch.column(1), [], [], []

            def out() -> pa.RecordBatch:
                columns = [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array([c[0] for c in cuts], pa.int32()),
                    pa.array([c[2] for c in cuts], pa.int64()),
                    pa.array([c[2] - c[1] for c in cuts], pa.int32()),
                    pa.array([c[4] for c in cuts], pa.bool_()),
                ]
                names = [key, "piece", "start", "overlap", "forced"]
                return pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.string())], names=[*names, "text"]) if texts else pa.RecordBatch.from_arrays(columns, names=names)

            size = 0
            for n in range(batch.num_rows):
                whole = values[n].as_py()
                new = [(i, *c) for i, c in enumerate(split_text(whole, limit, overlap))]
                at += [n] * len(new)
                cuts += new
                own += [whole[c[1] : c[3]] for c in new] if texts else ()
                size += len(whole)
                if size > _BATCH_CHARS:
                    yield out()
                    at, cuts, own, size = [], [], [], 0
            if at:
                yield out()

    rows = df.select(F.col(key), F.col(text).alias("_text")).where("_text IS NOT NULL")
    return rows.mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, overlap int, forced boolean" + (", text string" if texts else ""))
