"""Editorial or mechanical: the ordered rules, and other row-wise labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import (
    CONVERSION_CATEGORIES,
    DESTINATION_CATEGORIES,
    NAVIGATION_LINK_TYPES,
    NAVIGATION_ORIGINS,
    PAGE_TYPES,
    PATH_FRAGMENTS,
    SHORT_ANCHOR_ALLOWED,
    SIMPLE_ANCHOR_PATTERNS,
    SIMPLE_ORIGINS,
    SIMPLE_PATH_FRAGMENTS,
    AuditConfig,
)
from ..functions.binding import let
from ..functions.text import contains_any, matches_any, py_strip, py_words, starts_with_any
from ..functions.urls import slash_count

EDITORIAL = "editorial"
URL_STARTS = ("http://", "https://", "www.")


def link_rule(cfg: AuditConfig) -> Column:
    """The first of seven rules that makes a link mechanical, or ``editorial``.

    Each text is bound once: a filter on the rule is pushed down to the scan together with copies
    of everything the rule mentions, which would otherwise multiply with the tests on it.
    """

    def rules(anchor: Column, path: Column) -> Column:
        return (
            F.when(let(F.lower("origin"), lambda o: contains_any(o, NAVIGATION_ORIGINS)), F.lit("origin"))
            .when(F.lower("link_type").isin(*NAVIGATION_LINK_TYPES), F.lit("link_type"))
            .when(matches_any(anchor, cfg.anchor_patterns), F.lit("anchor_pattern"))
            .when(contains_any(path, PATH_FRAGMENTS), F.lit("path"))
            .when(contains_any(path, (s.replace(".", "") for s in cfg.selectors)), F.lit("selector"))
            .when((F.length(anchor) <= 2) & ~anchor.isin(*SHORT_ANCHOR_ALLOWED), F.lit("short_anchor"))
            .when(starts_with_any(anchor, URL_STARTS), F.lit("url_anchor"))
            .otherwise(F.lit(EDITORIAL))
        )

    return let(py_strip(F.lower("anchor")), lambda a: let(F.lower("path"), lambda p: rules(a, p)))


def simple_link_rule() -> Column:
    """The reduced rule set: exact origins, fixed anchors, three path groups."""

    def rules(anchor: Column, path: Column) -> Column:
        return (
            F.when(F.lower("origin").isin(*SIMPLE_ORIGINS), F.lit("origin"))
            .when(matches_any(anchor, SIMPLE_ANCHOR_PATTERNS), F.lit("anchor_pattern"))
            .when(contains_any(path, SIMPLE_PATH_FRAGMENTS), F.lit("path"))
            .otherwise(F.lit(EDITORIAL))
        )

    return let(py_strip(F.lower("anchor")), lambda a: let(F.lower("path"), lambda p: rules(a, p)))


def _with_class(links: DataFrame, rule: Column) -> DataFrame:
    return links.withColumn("rule", rule).withColumn("is_mechanical", F.col("rule") != EDITORIAL)


def classify_links(links: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Adds ``rule`` and ``is_mechanical``."""
    return _with_class(links, link_rule(cfg))


def classify_links_simple(links: DataFrame) -> DataFrame:
    return _with_class(links, simple_link_rule())


def editorial(links: DataFrame) -> DataFrame:
    return links.where(~F.col("is_mechanical"))


def quality_flags(anchor: Column) -> dict[str, Column]:
    """Non-exclusive quality flags of an anchor; all false for a blank one.

    Anchors of seven or eight words, and single words of four characters or more, belong to
    no length bucket.
    """
    anchor = py_strip(anchor)
    n = F.size(py_words(anchor))

    def repeats(words: Column) -> Column:
        once = F.array_distinct(words)
        # a word that stands there three times is two words more than there are different ones
        few = F.size(words) - F.size(once) < 2
        return F.exists(F.when(few, F.slice(words, 1, 0)).otherwise(once), lambda w: F.size(F.filter(words, lambda v: v == w)) > 2)

    long_words = F.filter(py_words(F.lower(anchor)), lambda w: F.length(w) > 3)
    return {
        "too_short": (F.length(anchor) < 4) & (n == 1),
        # Nine words and eight blanks are 17 characters, three long words and two blanks 14.
        "too_long": (F.length(anchor) >= 17) & (n > 8),
        "good": n.between(2, 6),
        "keyword_stuffed": (F.length(anchor) >= 14) & let(long_words, repeats),
        "url_anchor": let(anchor, lambda a: starts_with_any(a, URL_STARTS)),
    }


def anchor_quality(links: DataFrame) -> DataFrame:
    """Editorial links with their quality flags."""
    kept = editorial(links)
    return kept.select("*", *(flag.alias(name) for name, flag in quality_flags(F.col("anchor")).items()))


def first_match(value: Column, categories: dict[str, tuple[str, ...]], otherwise) -> Column:
    """The first category with a fragment in the text."""
    chain = None
    for name, fragments in categories.items():
        test = contains_any(value, fragments)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain.otherwise(otherwise)


def destination_category(url: Column) -> Column:
    return first_match(F.lower(url), DESTINATION_CATEGORIES, F.lit("other"))


def page_type(url: Column) -> Column:
    section = (slash_count(url) <= 3) & ~url.endswith(".html")
    return first_match(
        F.lower(url), PAGE_TYPES, F.when(section, F.lit("section")).otherwise(F.lit("specific"))
    )


def conversion_category(url: Column, title: Column) -> Column:
    """Category of a conversion page; null for other pages."""
    return first_match(
        F.concat(F.lower(url), F.lit(" "), F.lower(title)), CONVERSION_CATEGORIES, F.lit(None).cast("string")
    )


def word_count_band(count: Column) -> Column:
    return F.when(count < 300, F.lit("thin")).when(count > 1500, F.lit("rich")).otherwise(F.lit("quality"))


def score_rating(score: Column) -> Column:
    return F.when(score >= 80, F.lit("excellent")).when(score >= 60, F.lit("medium")).otherwise(F.lit("poor"))


def similarity_band(similarity: Column) -> Column:
    return F.when(similarity > 0.8, F.lit("high")).when(similarity > 0.6, F.lit("medium")).otherwise(F.lit("low"))
