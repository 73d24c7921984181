"""URLs and page ids, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wikiloom.functions.text import WHITE, col, strip_white

_DIGITS = r"^[+-]?[0-9]+$"


def whole_number(text: Column) -> Column:
    """bigint of a text of digits only; NULL for anything else, overflow included."""
    return F.when(text.rlike(_DIGITS), text.try_cast("bigint"))


def authority(url: Column | str) -> Column:
    """Lower-case host with port, without user info; NULL for relative and unparsable URLs."""
    return F.lower(F.regexp_replace(F.try_parse_url(col(url), F.lit("AUTHORITY")), "^[^@]*@", ""))


def is_absolute(url: Column | str) -> Column:
    return col(url).rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//")


def crawl_target(url: Column | str, allowed_host: str) -> Column:
    """``internal``, ``external`` or ``dropped`` for a link target.

    Without a host a target is internal (unparsable ones only if they start with ``/``); else its host decides, port
    included and in any case. Without an allowed host every absolute target is external.
    """
    u = strip_white(url)
    host = authority(u)
    same = host == F.lit(allowed_host.strip(WHITE).lower()) if allowed_host.strip(WHITE) else F.lit(False)
    readable = F.try_parse_url(F.when(is_absolute(u), u).otherwise(F.concat(F.lit("http://h/"), u)), F.lit("HOST")).isNotNull()
    return (
        F.when(u.isNull(), None)
        .when(~readable & ~is_absolute(u), F.when(u.startswith("/"), "internal").otherwise("dropped"))
        .when(~readable, "dropped")
        .when(~is_absolute(u), "internal")
        .when(same, "internal")
        .otherwise("external")
    )


def id_from_path(url: Column | str) -> Column:
    return whole_number(F.nullif(F.regexp_extract(col(url), "/(?:wiki/)?spaces/[^/]+/pages/([0-9]+)", 1), F.lit("")))


def page_id(url: Column | str) -> Column:
    """Page id of a URL: its ``pageId`` if that is a number, else the one in its path; 0 if there is none."""
    u = col(url)
    full = F.when(is_absolute(u), u).otherwise(F.concat(F.lit("http://h"), F.when(u.startswith("/"), u).otherwise(F.concat(F.lit("/"), u))))
    return F.coalesce(whole_number(F.try_parse_url(full, F.lit("QUERY"), F.lit("pageId"))), id_from_path(u), F.lit(0).cast("bigint"))


def seed_page_id(seed: Column | str) -> Column:
    """Page id of a seed: a positive number, the ``pageId`` of a URL, or the number after ``/pages/``; NULL if none."""
    s = strip_white(seed)
    query = F.try_parse_url(s, F.lit("QUERY"), F.lit("pageId"))
    loose = whole_number(F.nullif(F.regexp_extract(s, "/pages/([0-9]+)", 1), F.lit("")))
    found = F.when(s.rlike(_DIGITS), whole_number(s)).when(query.isNotNull(), whole_number(query)).otherwise(loose)
    return F.when(found > 0, found)


def space_key(url: Column | str) -> Column:
    """Path segment after ``spaces``; NULL if there is none."""
    return F.nullif(F.regexp_extract(col(url), r"^[^?#]*?/spaces/([^/?#]+)", 1), F.lit(""))


def parse_time(text: Column | str) -> Column:
    """Timestamp of an ISO text with zone; NULL where it has another form."""
    t = strip_white(text)
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"), t.try_cast("timestamp"))
