"""Visually identical text in one consistent form.

Width and font forms, presentation ligatures, kinds of space and hyphen, invisible characters and combining accents are
brought to one spelling; look-alike letters of different scripts are settled token by token. For each token the script sets of
its letters are intersected. An empty intersection is a mixed-script token; a token whose letters all have twins in
another script is a whole-script confusable. A mixed token is spelled in the script that its unambiguous letters have;
a token of ambiguous letters only in the script that the unambiguous letters of the whole text mostly have, or Latin.
The choice depends on what the letters look like and not on how they are stored, so texts that read the same get the
same form. Letter, accent, case, digit, punctuation and line breaks are kept.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.session import materialize

#: Letters that look alike in Latin and other scripts, written Latin first, then the others.
TWINS = {
    "Cyrillic": [
        ("a", "а"), ("c", "с"), ("d", "ԁ"), ("e", "е"), ("h", "һ"), ("i", "і"), ("j", "ј"), ("l", "ӏ"), ("o", "о"), ("p", "р"),
        ("q", "ԛ"), ("s", "ѕ"), ("w", "ԝ"), ("x", "х"), ("y", "у"),
        ("A", "А"), ("B", "В"), ("C", "С"), ("E", "Е"), ("G", "Ԍ"), ("H", "Н"), ("I", "І"), ("J", "Ј"), ("K", "К"), ("M", "М"),
        ("O", "О"), ("P", "Р"), ("Q", "Ԛ"), ("S", "Ѕ"), ("T", "Т"), ("W", "Ԝ"), ("X", "Х"), ("Y", "Ү"),
    ],
    "Greek": [
        ("a", "α"), ("i", "ι"), ("j", "ϳ"), ("o", "ο"), ("p", "ρ"), ("u", "υ"), ("v", "ν"), ("y", "γ"),
        ("A", "Α"), ("B", "Β"), ("E", "Ε"), ("H", "Η"), ("I", "Ι"), ("K", "Κ"), ("M", "Μ"), ("N", "Ν"), ("O", "Ο"), ("P", "Ρ"),
        ("T", "Τ"), ("X", "Χ"), ("Y", "Υ"), ("Z", "Ζ"),
    ],
    "Armenian": [("h", "հ"), ("n", "ո"), ("o", "օ"), ("u", "ս"), ("O", "Օ"), ("S", "Տ")],
}
_LATIN_TO = {script: {a: b for a, b in pairs} for script, pairs in TWINS.items()}
_TO_LATIN = {b: a for pairs in TWINS.values() for a, b in pairs}
_AMBIGUOUS = frozenset(_TO_LATIN) | {a for pairs in TWINS.values() for a, _ in pairs}

#: Cherokee letters that look like Latin ones. Whole words of the script have others too, so a word without
#: any of those is Latin and a word with one is Cherokee.
CHEROKEE = [
    ("A", "Ꭺ"), ("B", "Ᏼ"), ("C", "Ꮯ"), ("D", "Ꭰ"), ("E", "Ꭼ"), ("G", "Ꮐ"), ("H", "Ꮋ"), ("J", "Ꭻ"), ("K", "Ꮶ"), ("L", "Ꮮ"),
    ("M", "Ꮇ"), ("P", "Ꮲ"), ("R", "Ꮢ"), ("S", "Ꮪ"), ("T", "Ꭲ"), ("V", "Ꮩ"), ("W", "Ꮃ"), ("Z", "Ꮓ"), ("i", "Ꭵ"),
]
_FROM_CHEROKEE = {b: a for a, b in CHEROKEE}
_TO_CHEROKEE = {a: b for a, b in CHEROKEE}

_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]")
_CHEROKEE = regex.compile(r"\p{Cherokee}")
#: Format characters, but for the visible Arabic ones and for joiners within emoji sequences.
_INVISIBLE = regex.compile(
    r"(?<![\p{Extended_Pictographic}\ufe0f])\u200d|[[\p{Cf}\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0]--[\u0600-\u0605\u06dd\u070f\u08e2\u200d]]",
    regex.V1,
)
#: Latin letters whose twins are not in common use in a script, so that a whole token of ambiguous letters
#: among which they are is not taken for that script.
RARE = {"Cyrillic": frozenset("dhijlqswGIJQSWYvu"), "Greek": frozenset("j"), "Armenian": frozenset("S")}
_SCRIPTS = ("Latin", *TWINS)
_SCRIPT_OF = [(s, regex.compile(rf"\p{{Script_Extensions={s}}}")) for s in _SCRIPTS]


def _plain_forms() -> dict[int, str]:
    """Code points that stand for others of another width, for a space, a plain hyphen or the letters of a ligature."""
    out: dict[int, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        tag, _, rest = unicodedata.decomposition(ch).partition(" ")
        if tag in ("<wide>", "<narrow>", "<font>", "<noBreak>") or 0xFB00 <= cp <= 0xFB06:
            out[cp] = unicodedata.normalize("NFKC", ch) if 0xFB00 <= cp <= 0xFB06 else "".join(chr(int(x, 16)) for x in rest.split())
        if unicodedata.category(ch) == "Zs":
            out[cp] = " "
    return out | {0x2010: "-", 0x2011: "-"}


_PLAIN = _plain_forms()
# Two classes: one that the library looks up in a table, and all characters beyond the first plane.
_HAS_PLAIN = re.compile("[" + "".join(re.escape(chr(cp)) for cp in _PLAIN if cp < 0x10000) + "]")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _plain_form(m: re.Match) -> str:
    return _PLAIN.get(ord(m[0]), m[0])


@lru_cache(maxsize=65536)
def script_set(ch: str) -> frozenset:
    """Scripts that a letter can be read as: its own (with extensions) and those in which it has a twin."""
    own = {s for s, r in _SCRIPT_OF if r.match(ch)}
    latin = _TO_LATIN.get(ch, ch if "Latin" in own else None)
    if latin is not None:
        own |= {s for s in TWINS if latin in _LATIN_TO[s]} | {"Latin"} if ch in _AMBIGUOUS else set()
    return frozenset(own)


def _spell(token: str, script: str) -> str:
    """Ambiguous letters of a token in one script, all others as they are."""
    if script == "Latin":
        return "".join(_TO_LATIN.get(c, c) for c in token)
    table = _LATIN_TO[script]
    out = []
    for c in token:
        latin = _TO_LATIN.get(c, c)
        out.append(table.get(latin, latin) if c in _AMBIGUOUS else c)
    return "".join(out)


def _decided(token: str) -> Counter:
    """Number of unambiguous letters of each script."""
    return Counter(s for c in token if c not in _AMBIGUOUS for s in script_set(c))


def _settle(text: str, main: str | None) -> str:
    if main is None:
        whole: Counter = Counter()
        for ch, n in Counter("".join(_TOKEN.findall(text))).items():
            if ch not in _AMBIGUOUS:
                for s in script_set(ch):
                    whole[s] += n
        main = max(_SCRIPTS, key=lambda s: (whole[s], -_SCRIPTS.index(s)))

    return _TOKEN.sub(lambda m: settled(m[0], main), text)


@lru_cache(maxsize=262_144)
def settled(token: str, main: str) -> str:
    """A token in one script, within a text that is mainly in ``main``."""
    if _CHEROKEE.search(token):
        if any(_CHEROKEE.match(c) and c not in _FROM_CHEROKEE for c in token):
            return "".join(_TO_CHEROKEE.get(c, c) for c in token)
        token = "".join(_FROM_CHEROKEE.get(c, c) for c in token)
    if _AMBIGUOUS.isdisjoint(token):
        return token
    common = frozenset.intersection(*[s for c in token if (s := script_set(c))])
    if len(common) == 1:
        return _spell(token, next(iter(common)))
    if common:  # every letter has a twin: whole-script confusable
        rare = main in RARE and any(_TO_LATIN.get(c, c) in RARE[main] for c in token)
        return _spell(token, main if main in common and not rare else min(common, key=_SCRIPTS.index))
    decided = _decided(token)  # mixed scripts beyond look-alikes
    return _spell(token, max(_SCRIPTS, key=lambda s: (decided[s], -_SCRIPTS.index(s))))


def canonical_text(text: str | None, main: str | None = None) -> str | None:
    """The one form of all texts that read the same; None for None.

    ``main`` sets the script of tokens that could be of several; by default the text's own main script decides.
    """
    if text is None or text.isascii():
        return text
    text = _HAS_PLAIN.sub(_plain_form, _INVISIBLE.sub("", text))
    if not text.isascii() and _BEYOND.search(text):
        text = _BEYOND.sub(_plain_form, text)
    if _FOREIGN.search(text):
        text = _settle(unicodedata.normalize("NFD", text), main)
    return unicodedata.normalize("NFC", text)


def with_canonical(df: DataFrame, text: Column, name: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of ``text`` in a further column."""

    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return pd.Series([canonical_text(x) for x in s], dtype=object)

    return df.withColumn(name, convert(text))


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, exact): 128-bit digests of the canonical form and of the text itself; NULL texts are left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            forms = [canonical_text(x) for x in texts]
            exact = [_digest(x) for x in texts]
            same = [e if f is t or f == t else _digest(f) for f, t, e in zip(forms, texts, exact, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(exact, pa.binary())], names=[key, "form", "exact"])

    rows = df.select(F.col(key), F.col(text)).where(F.col(text).isNotNull() & F.col(key).isNotNull())
    return rows.mapInArrow(run, f"`{key}` {kind}, form binary, exact binary")


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), smaller key first: rows whose texts differ in their code points and read the same.

    Only digests are shuffled. Copies are first put together to one class per exact text, and classes of one form are
    paired; a form with a single exact text, however often it is repeated, ends there. Members join their classes last,
    so a class of a third of all rows meets only the few members of other spellings. NULL texts and keys take no part;
    empty texts are equal; repeated rows count once; an empty table gives no rows.
    """
    prints = materialize(fingerprints(df, key, text))
    classes = prints.groupBy("form", "exact").agg(F.lit(1).alias("one")).drop("one")
    many = classes.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    classes = materialize(classes.join(many, "form", "left_semi"))
    members = prints.join(classes.select("exact"), "exact", "left_semi").select(F.col(key), "exact").distinct()
    a, b = classes.toDF("form", "a"), classes.toDF("form", "b")
    pairs = a.join(b, "form").where(F.col("a") < F.col("b")).select("a", "b")
    left = members.select(F.col(key).alias("x"), F.col("exact").alias("a"))
    right = members.select(F.col(key).alias("y"), F.col("exact").alias("b"))
    found = pairs.join(left, "a").join(right, "b")
    return found.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def look_alike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, spelling_id): rows whose text reads like that of another row with other code points.

    The form of :func:`look_alike_pairs` that grows with the rows: two rows read the same if they have one class_id, and
    differ in their code points if they have different spelling_ids. Both are the least key of their group. Groups are
    combined map-side; nulls, repeats and empty tables are treated as there.
    """
    prints = materialize(fingerprints(df, key, text))
    spellings = materialize(prints.groupBy("form", "exact").agg(F.min(key).alias("spelling_id")))
    many = spellings.groupBy("form").agg(F.count("*").alias("n"), F.min("spelling_id").alias("class_id")).where("n > 1")
    known = spellings.join(many.select("form", "class_id"), "form").select("exact", "spelling_id", "class_id")
    return prints.join(known, "exact").select(key, "class_id", "spelling_id").distinct()
