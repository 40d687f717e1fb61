"""Links inside page HTML, and the match of crawled links against them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.html import LINK_SCHEMA, LinkScanner, html_h1, html_title, html_word_count, link_batches
from ..functions.text import py_strip
from ..functions.urls import url_join
from .filters import internal_by_domain


def extract_page_links(
    pages: DataFrame,
    zone_tags: tuple[str, ...] = ("main", "article", "section"),
    zone_classes: tuple[str, ...] = (),
    parser: Callable[[], Callable[[str], Iterable[Mapping]]] | None = None,
) -> DataFrame:
    """All links of pages ``(url, html)``: absolute URL, text, context, content zone, navigation.

    Element nesting decides zone and navigation, so the pages pass a parser in Arrow batches;
    only URL and HTML of pages that hold a link reach it. Where classes of content blocks are
    known they take the place of the ``section`` tag.

    ``parser`` makes another parser, once in each task: a function from the HTML of a page to its links in order, each a mapping with
    ``href`` and any of ``text``, ``context``, ``in_zone`` and ``in_nav``. It must be one that Spark can send to executors.
    """
    tags = tuple(t for t in zone_tags if t != "section") if zone_classes else zone_tags
    with_links = pages.where(F.lower("html").contains("<a")).select(F.col("url").alias("page_url"), "html")
    links = with_links.mapInArrow(link_batches(parser or (lambda: LinkScanner(tags, zone_classes).scan)), LINK_SCHEMA)
    return links.withColumn("href", url_join(F.col("page_url"), F.col("href")))


def extract_flat_links(pages: DataFrame) -> DataFrame:
    """``(page_url, position, href, text)`` of links without inner markup, by regular expressions alone.

    The native, several times faster form for pages known to be flat.
    """
    html = F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", "")
    anchor = r"""(?is)<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>"""
    found = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(anchor), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(anchor), F.lit(2)).alias("text"),
    )
    return pages.select(F.col("url").alias("page_url"), F.posexplode(found).alias("position", "link")).select(
        "page_url",
        "position",
        url_join(F.col("page_url"), F.col("link")["href"]).alias("href"),
        py_strip(F.col("link")["text"]).alias("text"),
    )


def nav_zone_links(extracted: DataFrame) -> DataFrame:
    return extracted.where("in_nav")


def content_zone_links(extracted: DataFrame) -> DataFrame:
    """Links of the content zones outside navigation, with a text of more than two characters.

    A link in nested zones is one row.
    """
    return extracted.where(F.col("in_zone") & ~F.col("in_nav") & (F.col("href") != "") & (F.length("text") > 2))


def page_attributes(pages: DataFrame) -> DataFrame:
    """``(url, title, h1, word_count)`` straight from HTML."""
    html = F.col("html")
    return pages.select(
        "url",
        html_title(html).alias("title"),
        html_h1(html).alias("h1"),
        html_word_count(html).alias("word_count"),
    )


def match_editorial_links(links: DataFrame, content_links: DataFrame, host: str | None = None) -> DataFrame:
    """Crawled links that a content zone of their source page holds too.

    URLs must agree but for closing slashes, and texts must be equal, or the anchor must be
    longer than 3 characters and part of the text. What a page offers at one URL is one row with its distinct texts, so each link meets one row
    at most, and links and texts are shuffled once each, by page and URL.
    """
    slash = F.lit("/")
    kept = internal_by_domain(links, host, strict=False) if host else links
    offered = (
        content_links.select(
            F.col("page_url").alias("_page"), F.rtrim(F.col("href"), slash).alias("_url"), py_strip(F.col("text")).alias("_link_text")
        )
        .groupBy("_page", "_url")
        .agg(F.collect_set("_link_text").alias("_texts"))
    )

    def agrees(anchor: Column) -> Column:
        lowered = F.lower(anchor)
        return F.array_contains("_texts", anchor) | ((F.length(anchor) > 3) & F.exists("_texts", lambda t: F.lower(t).contains(lowered)))

    same_place = (F.col("source") == F.col("_page")) & (F.rtrim(F.col("destination"), slash) == F.col("_url"))
    return kept.join(offered, same_place & agrees(py_strip(F.col("anchor"))), "left_semi").select(*links.columns)
