"""String helpers that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Every character that Unicode calls white space, and the four information separators.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_white(c: Column | str) -> Column:
    """Remove white space of any kind at both ends (Spark's ``trim`` removes U+0020 only)."""
    return F.btrim(col(c), F.lit(WHITE))


def blank_to_null(c: Column | str) -> Column:
    """Stripped text, or NULL where nothing is left."""
    return F.nullif(strip_white(c), F.lit(""))


def to_id(c: Column | str) -> Column:
    """A padded text id as bigint; NULL where it is not a whole number."""
    text = strip_white(c)
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def canonical_signature(c: Column | str) -> Column:
    """Attachment signature whose ``;``-separated parts come in sorted order; NULL for every kind of blank."""
    text = blank_to_null(c)
    return F.when(text.contains(";"), F.array_join(F.array_sort(F.split(text, ";", -1)), ";")).otherwise(text)
