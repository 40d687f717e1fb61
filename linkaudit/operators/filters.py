"""Row filters on link, page and URL tables: narrow, native, no shuffle.

Link tables are canonical: no nulls, no blanks around URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import SKIPPED_URL_PARTS
from ..functions.text import contains_any, py_strip
from ..functions.urls import url_host, url_path, url_root


def is_valid() -> Column:
    return (F.col("source") != "") & (F.col("destination") != "")


def is_internal() -> Column:
    """Equal hosts; two relative URLs count as internal."""
    return url_host(F.col("source")) == url_host(F.col("destination"))


def valid_links(links: DataFrame) -> DataFrame:
    return links.where(is_valid())


def internal_links(links: DataFrame) -> DataFrame:
    return links.where(is_valid() & is_internal())


def external_links(links: DataFrame) -> DataFrame:
    return links.where(is_valid() & ~is_internal())


def internal_by_domain(links: DataFrame, host: str, strict: bool = True) -> DataFrame:
    """Links to a site. Not strict: any destination that begins with the site's address."""
    destination = F.col("destination")
    if strict:
        return links.where(destination.rlike("^https?://") & (url_host(destination) == host))
    return links.where(destination.startswith(f"http://{host}") | destination.startswith(f"https://{host}"))


def url_prefix_filter(links: DataFrame, prefix: str) -> DataFrame:
    """Links with either end under a prefix."""
    return links.where(F.col("source").startswith(prefix) | F.col("destination").startswith(prefix))


def page_prefix_filter(pages: DataFrame, prefix: str, url: str = "url") -> DataFrame:
    return pages.where(F.col(url).startswith(prefix))


def section_filter(links: DataFrame, section: str) -> DataFrame:
    """Links with the section text anywhere in either end."""
    return links.where(F.col("source").contains(section) | F.col("destination").contains(section))


def section_path(section: Column) -> Column:
    """A section as typed by a user -> path for ``section_filter``; empty where it is no section."""
    from_url = F.rtrim(url_path(section), F.lit("/"))
    stripped = py_strip(section)
    rooted = F.rtrim(F.when(stripped.startswith("/"), stripped).otherwise(F.concat(F.lit("/"), stripped)), F.lit("/"))
    slashes = F.length(rooted) - F.length(F.replace(rooted, F.lit("/"), F.lit("")))
    cleaned = F.when((F.length(rooted) > 1) & (slashes <= 3), rooted).otherwise(F.lit(""))
    return (
        F.when(section == "", F.lit(""))
        .when(section.rlike("^https?://") & (from_url != ""), from_url)
        .otherwise(cleaned)
    )


def crawlable_urls(urls: DataFrame, host: str, skip: str = "deep", section: str = "") -> DataFrame:
    """URLs that mention the site's host and none of the fragments of a skip list."""
    url = F.col("url")
    kept = urls.where(url.contains(host) & ~contains_any(F.lower(url), SKIPPED_URL_PARTS[skip]))
    return kept.where(url.contains(section)) if section else kept


def site_url(links: DataFrame) -> DataFrame:
    """Root of the audited site: the most frequent root among the sources, one row."""
    return (
        links.groupBy(url_root(F.col("source")).alias("site_url"))
        .agg(F.count(F.lit(1)).alias("links"))
        .where("site_url IS NOT NULL")
        .orderBy(F.desc("links"), "site_url")
        .limit(1)
    )
