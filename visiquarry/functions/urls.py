"""URL functions as column expressions. A URL that does not parse keeps its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import root_domain


def url_path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))


def url_host(url: Column) -> Column:
    """Host with its port in lower case, without ``www.``; null where the URL does not parse."""
    authority = F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), "^.*@", "")
    return F.regexp_replace(F.lower(authority), r"^www\.", "")


def canonical_url_key(url: Column) -> Column:
    """Scheme, fragment, ``www.``, a closing ``index.html`` and one closing slash dropped, query parameters in order."""
    path = F.regexp_replace(url_path(url), r"/index\.html$", "/")
    path = F.when((F.length(path) > 1) & F.endswith(path, F.lit("/")), F.left(path, F.length(path) - 1)).otherwise(path)
    query = F.try_parse_url(url, F.lit("QUERY"))
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    key = F.concat(url_host(url), path, F.when(query.isNotNull() & (query != ""), F.concat(F.lit("?"), ordered)).otherwise(""))
    return F.coalesce(key, url)


def url_template(url: Column) -> Column:
    """'/' for a home page, '/:sayfa' for one segment, else the first segment and a mark for each further one."""
    parts = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    rest = F.array_join(F.transform(F.slice(parts, 2, 1000), lambda _: F.lit(":sayfa")), "/")
    return F.when(F.size(parts) == 0, "/").when(F.size(parts) == 1, "/:sayfa").otherwise(F.concat(F.lit("/"), F.get(parts, 0), F.lit("/"), rest))


def locale_prefix(url: Column) -> Column:
    """First path segment in lower case if it is a language code, else an empty string."""
    return F.lower(F.regexp_extract(url_path(url), r"^/+([A-Za-z]{2}(?:-[A-Za-z]{2})?)(?:/|$)", 1))


def same_site(url: Column, domain: Column) -> Column:
    """The URL's host, ``www.`` apart, is the domain; false for null."""
    return F.coalesce(root_domain(url) == domain, F.lit(False))


def excluded_path(url: Column, prefixes: Column) -> Column:
    """The path equals an excluded one or lies below it."""
    path = url_path(url)
    return F.exists(prefixes, lambda p: (path == p) | F.startswith(path, F.concat(F.rtrim(p, F.lit("/")), F.lit("/"))))
