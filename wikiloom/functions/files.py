"""File names, paths and quoted strings."""

from __future__ import annotations

import posixpath
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

from wikiloom.functions.text import col


def attachment_filename(page_id: Column | str, name: Column | str) -> Column:
    """Safe name under which a page's attachment is stored (JVM-side)."""
    plain = F.regexp_replace(F.translate(col(name), " /\\", "___"), r"[\x00-\x1f\x7f]", "")
    return F.concat(col(page_id).cast("string"), F.lit("_"), F.coalesce(F.nullif(F.btrim(plain, F.lit(". ")), F.lit("")), F.lit("attachment")))


def attachment_path(filename: Column | str) -> Column:
    return F.concat(F.lit("attachments/"), col(filename))


def managed_path(path: Column | str) -> Column:
    """Path with forward slashes and without dots and doubled slashes; NULL for blank ones."""

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return pd.Series([normalize_path(x) for x in s], dtype=object)

    # Most paths are clean already and stay in the JVM.
    p = F.regexp_replace(F.trim(col(path)), r"\\", "/")
    return F.when(p == "", None).when(p.rlike(r"(^|/)\.{1,2}(/|$)|//|/$"), clean(p)).otherwise(p)


def normalize_path(path: str | None) -> str | None:
    if path is None or not path.strip():
        return None
    return posixpath.normpath(path.strip().replace("\\", "/"))


def inside_folder(folder: str, path: str) -> bool:
    """Whether ``path`` stays within ``folder`` once both are resolved."""
    base, full = posixpath.abspath(folder), posixpath.abspath(path)
    return posixpath.commonpath([base, full]) == base


#: Latin spellings of letters that do not decompose to Latin ones.
LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "і": "i", "є": "ie", "ґ": "g",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i",
}
#: Signs that titles' words are kept or joined by.
SIGNS = {"&": "and", "@": "at", "'": "", '"': "", "\u2019": ""}
_NAMED = re.compile(r"(?:HANGUL SYLLABLE|(?:HIRAGANA|KATAKANA) LETTER(?: SMALL)?) ([A-Z]+)$")


def latin(ch: str) -> str:
    """One character in ASCII: without accents, by the table, or as its Unicode name spells it (kana, Hangul); a space
    for anything else, ideographs among them."""
    if ch.isascii():
        return ch
    base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)) or " "
    if base.isascii():
        return base
    if (known := LETTERS.get(base if base in LETTERS else ch)) is not None:
        return known
    named = _NAMED.match(unicodedata.name(ch, ""))
    return named[1].lower() if named else " "


def slug(title: str) -> str:
    """Lower-case ASCII words joined by hyphens; letters of other scripts are spelled in Latin ones."""
    text = unicodedata.normalize("NFC", title).lower()
    for sign, word in SIGNS.items():
        text = text.replace(sign, word)
    return re.sub(r"-{2,}", "-", re.sub(r"[^a-z0-9_-]", "-", "".join(map(latin, text)).lower())).strip("-_")


def page_filename(title: str, page_id: str) -> str:
    return f"{slug(title) or 'page'}_{page_id}.md"


_SHORT = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", '"': '\\"', "\\": "\\\\"}


def quote(text: str) -> str:
    """Double-quoted string with printable Unicode kept and everything else escaped."""
    out = []
    for ch in text:
        if ch in _SHORT:
            out.append(_SHORT[ch])
        elif ch == " " or (ch.isprintable() and ch != "\x7f"):
            out.append(ch)
        elif ord(ch) < 0x80:
            out.append(f"\\x{ord(ch):02x}")
        else:
            out.append(f"\\u{ord(ch):04x}" if ord(ch) < 0x10000 else f"\\U{ord(ch):08x}")
    return '"' + "".join(out) + '"'


def quoted(text: Column | str) -> Column:
    """Quoted column: plain texts in the JVM, those with control or unusual characters in a UDF."""

    @F.pandas_udf("string")
    def hard(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else quote(x) for x in s], dtype=object)

    t = col(text)
    easy = F.concat(F.lit('"'), F.regexp_replace(t, r'([\\"])', r"\\$1"), F.lit('"'))
    return F.when(t.rlike(r"^[\x20-\x7e\p{L}\p{N}]*$"), easy).otherwise(hard(t))
