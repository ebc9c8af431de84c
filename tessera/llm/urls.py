"""Parts and canonical form of a URL as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# query parameters that only name the referrer
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), "^[^/?#]*", 0)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slash, other query parameters in order.

    Scheme, fragment and tracking parameters go; a URL without ``://`` has no
    canonical form (null).
    """
    name = F.regexp_replace(F.regexp_replace(host(url), "^www\\.", ""), ":(80|443)$", "")
    query = F.regexp_extract(after_scheme(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(name, F.regexp_replace(path(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(after_scheme(url).isNotNull(), whole)


CANONICAL_SQL = """
    CASE WHEN strpos(url, '://') > 0 THEN
      regexp_replace(regexp_replace({host}, '^www\\.', ''), ':(80|443)$', '')
      || regexp_replace({path}, '/+$', '')
      || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END
    END"""
REST_SQL = "substr(url, strpos(url, '://') + 3)"
HOST_SQL = (
    "CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(" + REST_SQL + ", '^[^/?#]*'), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
)
PATH_SQL = "CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(" + REST_SQL + ", '^[^/?#]*([^?#]*)', 1) ELSE '' END"
QUERY_SQL = (
    "array_to_string(list_sort(list_filter(string_split(regexp_extract(" + REST_SQL + ", '^[^?#]*\\?([^#]*)', 1), '&'), "
    "lambda p: p <> '' AND NOT regexp_matches(p, '" + TRACKING + "'))), '&')"
)
CANONICAL_SQL = CANONICAL_SQL.format(host=f"({HOST_SQL})", path=f"({PATH_SQL})", query=QUERY_SQL)
