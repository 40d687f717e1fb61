"""Correction of link classes by link labels from another source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from ..functions.text import py_strip
from ..session import stored
from .prefixes import beginning

EDITORIAL_CATEGORIES = ("EDITORIAL", "CALL_TO_ACTION")


#: Labels of a page that travel as one row with it; the links of a page with more are matched by sweeps and joins.
LABELS_AT_ONCE = 256
#: Comparisons of the links of one page with its labels in one task; beyond that the page's links are split by Spark.
COMPARED_AT_ONCE = 5_000_000


def _base(url: str) -> Column:
    return F.substring_index(url, "?", 1)


def _pages(labels: DataFrame) -> DataFrame:
    """``(base, page_url, ord, labels)`` for each labelled page, its URL up to its query as ``base``."""
    first = F.min("ord") if "ord" in labels.columns else F.lit(0)
    return labels.groupBy("page_url").agg(F.count(F.lit(1)).alias("labels"), first.alias("ord")).withColumn("base", _base("page_url"))


def _places(sources: DataFrame, labels: DataFrame) -> DataFrame:
    """``(base, links, labels, ord, several)`` for each URL up to its query: its rows in ``sources`` and in ``labels``, the ``ord`` of its first page, and
    whether several labelled pages share it."""
    if "ord" in labels.columns:
        pages = _pages(labels)
    else:
        pages = labels.select(_base("page_url").alias("base"), "page_url", F.lit(0).alias("ord"), F.lit(1).cast("long").alias("labels"))
    none = F.lit(None).cast("long")
    pages = pages.select("base", F.lit(0).cast("long").alias("links"), "labels", "ord", F.xxhash64("page_url").alias("page"))
    sources = sources.select(_base("source").alias("base"), F.lit(1).cast("long").alias("links"), none.alias("labels"), F.lit(None).alias("ord"), none.alias("page"))
    # a page without any order comes before all others
    first = F.when(F.count("ord") == F.count("page"), F.min("ord")).alias("ord")
    several = (F.count("page") > 0) & (F.min("page") != F.max("page"))
    both = sources.unionByName(pages).where("base IS NOT NULL").groupBy("base")
    return stored(both.agg(F.sum("links").alias("links"), F.coalesce(F.sum("labels"), F.lit(0)).alias("labels"), first, several.alias("several")))


def _first_pages(labels: DataFrame, places: DataFrame) -> DataFrame:
    """``(base, page_url)``: the page that counts, for bases of several."""
    pages = _pages(labels).join(places.where("several").select("base"), "base", "left_semi")
    return pages.groupBy("base").agg(F.min(F.struct("ord", "page_url")).alias("first")).select("base", "first.page_url")


def _pages_of_others(places: DataFrame, ordered: bool, page_match: str) -> DataFrame | None:
    """``(base, key)``: the labelled ``key`` that begins each base, where that need not be the base itself.

    Without an order no labelled URL is longer than an equal one, so only bases that have none are searched for.
    """
    if page_match == "page":
        return None
    searched = places.where("links > 0" if ordered else "links > 0 AND labels = 0")
    if searched.isEmpty():
        return None
    pages = places.where("labels > 0").select(F.col("base").alias("key"), "ord")
    found = beginning(searched.select(F.lit("").alias("group"), F.col("base").alias("text")), pages.select(F.lit("").alias("group"), F.col("key").alias("text")))
    rank = F.struct("ord", (-F.length("key")).alias("shorter"), "key")
    found = found.select(F.col("text").alias("base"), F.col("prefix").alias("key")).join(pages, "key")
    found = stored(found.groupBy("base").agg(F.min(rank).alias("first")).select("base", "first.key"))
    return None if found.isEmpty() else found


def _keyed(links: DataFrame, others: DataFrame | None) -> DataFrame:
    """``links`` with ``_key``: what a page that is labelled for their source begins with, if there is one."""
    if others is None:
        return links.withColumn("_key", _base("source"))
    moved = others.select(F.col("base").alias("_base"), F.col("key").alias("_moved"))
    keyed = links.withColumn("_base", _base("source")).join(moved, "_base", "left")
    return keyed.withColumn("_key", F.coalesce("_moved", "_base")).drop("_base", "_moved")


def label_page_of_sources(sources: DataFrame, labels: DataFrame, page_match: str = "prefix") -> DataFrame:
    """``(source, page_url)``: the labelled page each source belongs to.

    ``prefix``: the labelled URL up to its query begins the source URL: both are equal up to the query, or it is found by one sweep over both in order.
    ``page``: both URLs agree up to the query. Of several
    pages the first by ``ord`` counts; without ``ord`` the longest, then the smallest URL.
    """
    sources = sources.select("source").distinct()
    places = _places(sources, labels)
    pages = _pages(labels).groupBy("base").agg(F.min(F.struct("ord", "page_url")).alias("first")).select(F.col("base").alias("_key"), "first.page_url")
    return _keyed(sources, _pages_of_others(places, "ord" in labels.columns, page_match)).join(pages, "_key").select("source", "page_url")


def match_labels(links: DataFrame, labels: DataFrame, page_match: str = "prefix") -> DataFrame:
    """``(source, text, url, category, confidence)``: the first label that fits each distinct link.

    A label of the link's page fits if the texts are equal, or if one text contains the other and
    the link's URL ends in the label's last path segment. Links and labels are reduced to distinct
    rows first and written once. Equal texts are an equi-join on page and text. The segments that end a URL are found by a sweep over
    the reversed URLs and segments of each page, then joined on page and segment. A link meets the labels of one page
    only; the sweep deals the links of a page to many ranges, and joins are split by Spark where a page has very many. The smallest
    label is kept as the joined rows come, before any shuffle.
    """
    wanted = stored(links.select("source", "text", "url").distinct())
    found = label_page_of_sources(wanted.select("source").distinct(), labels, page_match)
    wanted = stored(wanted.join(found, "source"))

    order = F.col("ord") if "ord" in labels.columns else F.lit(0)
    url = py_strip(F.lower("href"))
    offered = labels.select(
        "page_url",
        py_strip(F.lower("text")).alias("label_text"),
        F.element_at(F.split(url, "/"), -1).alias("segment"),
        F.struct(order.alias("ord"), "href", "text", "category", "confidence").alias("label"),
    )
    offered = stored(offered.groupBy("page_url", "segment", "label_text").agg(F.min("label").alias("label")))
    by_text = offered.groupBy("page_url", F.col("label_text").alias("text")).agg(F.min("label").alias("label"))

    key = ["source", "text", "url"]
    equal = wanted.join(by_text, ["page_url", "text"]).select(*key, "label")
    points = wanted.select(F.col("page_url").alias("group"), F.reverse("url").alias("text"), F.col("text").alias("link_text"), "source")
    ends = beginning(points, offered.select(F.col("page_url").alias("group"), F.reverse("segment").alias("text")))
    ends = ends.select(
        "source", F.col("link_text").alias("text"), F.reverse("text").alias("url"), F.col("group").alias("page_url"), F.reverse("prefix").alias("segment")
    )
    contained = (
        ends.join(offered, ["page_url", "segment"])
        .where(F.col("label_text").contains(F.col("text")) | F.col("text").contains(F.col("label_text")))
        .select(*key, "label")
    )
    return (
        equal.unionByName(contained)
        .groupBy(*key)
        .agg(F.min("label").alias("label"))
        .select(*key, "label.category", "label.confidence")
    )


def _large(places: DataFrame) -> DataFrame:
    return places.where(F.col("labels") > LABELS_AT_ONCE).select(F.col("base").alias("_key"))


def _labels_of_pages(labels: DataFrame, places: DataFrame) -> DataFrame:
    """``(_key, _labels)``: the labels of each page that has few, ready to be compared; by its URL up to the query."""
    rows = labels.withColumn("_key", _base("page_url"))
    if not places.where("several").isEmpty():
        first = _first_pages(labels, places).select(F.col("base").alias("_key"), F.col("page_url").alias("_first"))
        rows = rows.join(first, "_key", "left").where("_first IS NULL OR page_url = _first")
    large = _large(places)
    if not large.isEmpty():
        rows = rows.join(large, "_key", "left_anti")
    order = F.col("ord") if "ord" in labels.columns else F.lit(0)
    label = F.struct(order.alias("ord"), "href", "text", "category", "confidence")
    prepared = F.transform(
        "_labels",
        lambda x: F.struct(
            x.alias("label"), py_strip(F.lower(x["text"])).alias("text"), F.substring_index(py_strip(F.lower(x["href"])), "/", -1).alias("segment")
        ),
    )
    return rows.where("_key IS NOT NULL").groupBy("_key").agg(F.collect_list(label).alias("_labels")).select("_key", prepared.alias("_labels"))


def _first_fitting(text: Column, url: Column) -> Column:
    """The smallest of ``_labels`` that fits a link; none without a URL."""

    def fits(x: Column, t: Column, u: Column) -> Column:
        return (x["text"] == t) | (x["text"].contains(t) | t.contains(x["text"])) & u.endswith(x["segment"])

    return let(text, lambda t: let(url, lambda u: F.when(u.isNotNull(), F.array_min(F.filter("_labels", lambda x: fits(x, t, u)))["label"])))


def apply_label_overrides(classified: DataFrame, labels: DataFrame, page_match: str = "prefix") -> DataFrame:
    """Classified links with ``is_mechanical`` turned round where a label says otherwise.

    Adds ``label_corrected``, ``label_category`` and ``label_confidence``, the latter two set on
    corrected links only. Where links have an ``alt_text``, it stands for an empty anchor. Which label fits is told by the rules of ``match_labels``.

    Links and labels move once, each to the URL of their page up to its query; links whose page has another URL move to that one before.
    Only the links of pages with more than ``LABELS_AT_ONCE`` labels go through ``match_labels``.
    """
    anchor = F.col("anchor")
    if "alt_text" in classified.columns:
        anchor = F.when(py_strip(anchor) == "", F.coalesce("alt_text", F.lit(""))).otherwise(anchor)
    text, url = py_strip(F.lower(anchor)), py_strip(F.lower("destination"))
    places = _places(classified, labels)
    others = _pages_of_others(places, "ord" in labels.columns, page_match)
    links = _keyed(classified, others)
    few = _labels_of_pages(labels, places)
    if _is_split(places, others):
        few = stored(few)
    joined = links.join(few, "_key", "left").withColumn("_label", _first_fitting(text, url))
    category, confidence = F.col("_label.category"), F.col("_label.confidence")
    large = _large(places)
    if not large.isEmpty():
        some = links.join(large, "_key", "left_semi").select("source", text.alias("text"), url.alias("url"))
        offered = labels.withColumn("_key", _base("page_url")).join(large, "_key", "left_semi").drop("_key")
        found = match_labels(some, offered, page_match)
        found = found.select("source", F.col("text").alias("_text"), F.col("url").alias("_url"), F.struct("category", "confidence").alias("_found"))
        joined = joined.withColumn("_text", text).withColumn("_url", url).join(found, ["source", "_text", "_url"], "left")
        category, confidence = F.coalesce(category, "_found.category"), F.coalesce(confidence, "_found.confidence")
    says_editorial = category.isin(*EDITORIAL_CATEGORIES)
    corrected = F.coalesce(F.col("is_mechanical") == says_editorial, F.lit(False))
    return (
        joined.withColumn("label_corrected", corrected)
        .withColumn("is_mechanical", F.when(corrected, ~F.col("is_mechanical")).otherwise(F.col("is_mechanical")))
        .withColumn("label_category", F.when(F.col("label_corrected"), category))
        .withColumn("label_confidence", F.when(F.col("label_corrected"), confidence))
        .select(*classified.columns, "label_corrected", "label_category", "label_confidence")
    )


def _is_split(places: DataFrame, others: DataFrame | None) -> bool:
    """Whether a page has so many links and labels that its links are split, which Spark does where both sides come from tables."""
    links = places.select("base", "links")
    if others is not None:
        links = links.join(others, "base", "left").withColumn("base", F.coalesce("key", "base")).groupBy("base").agg(F.sum("links").alias("links"))
    compared = links.join(places.where(F.col("labels").between(1, LABELS_AT_ONCE)).select("base", "labels"), "base")
    return not compared.where(F.col("links") * F.col("labels") > COMPARED_AT_ONCE).isEmpty()


def correction_counts(corrected: DataFrame) -> DataFrame:
    """Corrected links per label category."""
    # only corrected links have a category; a filter on them would be pushed down with a second copy of the comparison
    counted = corrected.groupBy("label_category").agg(F.count_if("label_corrected").alias("corrections"))
    return counted.where("corrections > 0")
