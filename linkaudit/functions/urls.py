"""URL expressions on the RFC 3986 groups; malformed URLs never raise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"


def url_host(url: Column) -> Column:
    """Network location with user, port and case kept; empty for relative URLs.

    Reads ``url`` once: Catalyst copies the expression behind it into pushed-down filters.
    """
    return F.regexp_extract(url, _SCHEME + r"//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)


def url_root(url: Column) -> Column:
    """``scheme://host/``; null unless both parts are there."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when(root != "", F.concat(root, F.lit("/")))


def url_label(url: Column) -> Column:
    """Short display form: the path without closing slashes, at most 30 characters."""
    path = F.rtrim(url_path(url), F.lit("/"))
    return (
        F.when(path == "", F.lit("/"))
        .when(F.length(path) > 30, F.concat(F.substring(path, 1, 27), F.lit("...")))
        .otherwise(path)
    )


def slash_count(url: Column) -> Column:
    return F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))


def _without_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path that starts with a slash, by a fold over its segments."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    inner = F.filter(F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0))), lambda s: s != "")
    kept = F.aggregate(
        F.concat(inner, F.array(last)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    closing = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, closing), "/"))


def url_join(base: Column, ref: Column) -> Column:
    """Absolute form of a reference found on the page at ``base``."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    base_path = url_path(base)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_extract(base_path, r"^(.*/)", 1))
    path = F.when(ref.startswith("/"), ref_path).otherwise(F.concat(folder, ref_path))
    resolved = F.when(path.rlike(r"/\.{1,2}(/|$)"), _without_dot_segments(path)).otherwise(path)
    return (
        F.when(ref == "", base)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), ref))
        .when(ref.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), ref))
        .otherwise(F.concat(site, resolved, ref_tail))
    )
