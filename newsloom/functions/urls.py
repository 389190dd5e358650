"""URL expressions: normal form, site name, link-dump variants, article id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cut(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def with_scheme(c: Column) -> Column:
    """``https://`` in front of addresses that name no http(s) scheme."""
    return F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit("https://"), c))


def normalize_url(c: Column) -> Column:
    """Canonical article address; an address that ends up empty becomes null.

    The order of the steps matters: ``/index.html/`` is kept because the trailing slash
    goes last.
    """
    bare = _cut(_cut(F.lower(c), "?"), "#")
    bare = F.regexp_replace(bare, "/index\\.html\\z", "")
    bare = F.regexp_replace(bare, "^(https?://)www\\.", "$1")
    bare = F.replace(bare, F.lit("http://"), F.lit("https://"))
    return _blank_to_null(F.regexp_replace(bare, "/\\z", ""))


def _without_scheme(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))


def url_domain(c: Column) -> Column:
    """Site name of an address; the "source" of all analyses."""
    host = F.replace(_without_scheme(F.lower(c)), F.lit("www."), F.lit(""))
    return _cut(_cut(_cut(host, "/"), "?"), "#")


def link_domain(c: Column) -> Column:
    """Site name as the link dumps need it: trimmed, and a fragment is not cut off."""
    host = F.replace(_without_scheme(F.trim(F.lower(c))), F.lit("www."), F.lit(""))
    return _cut(_cut(host, "/"), "?")


def link_url(c: Column) -> Column:
    """Address form of the URL list: case and ``www.`` kept, scheme and query removed."""
    return _blank_to_null(F.regexp_replace(_cut(_without_scheme(c), "?"), "/\\z", ""))


def article_id(c: Column) -> Column:
    return F.translate(_without_scheme(F.lower(c)), "/.", "__")
