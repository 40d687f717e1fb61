"""Counts, ratios, scores and top lists over link tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import AuditConfig
from ..functions.text import py_strip
from ..functions.urls import url_host
from .classify import destination_category, editorial, quality_flags, score_rating
from .filters import is_internal, is_valid


def count_if(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def ratio(part: Column, whole: Column, factor: float = 1.0) -> Column:
    """``part / whole * factor``; 0 where there is no whole."""
    return F.when(whole > 0, part / whole * F.lit(factor)).otherwise(F.lit(0.0))


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The ``n`` largest rows, ties by key; never sorts the whole table."""
    return df.orderBy(F.desc(by), *ties).limit(n)


RULES = ("origin", "link_type", "anchor_pattern", "path", "selector", "short_anchor", "url_anchor")
QUALITY_BUCKETS = ("too_short", "too_long", "good", "keyword_stuffed", "url_anchor")

# --- whole-table figures, one pass each ----------------------------------------


def link_figures(classified: DataFrame) -> DataFrame:
    """Every whole-table count of an audit from one pass: funnel, rules and quality buckets, one row."""
    valid = is_valid()
    internal = valid & is_internal()
    mechanical = F.col("is_mechanical")
    flags = quality_flags(F.col("anchor"))
    judged = classified.select(
        valid.alias("valid"),
        internal.alias("internal"),
        (internal & ~mechanical).alias("editorial"),
        F.when(internal & mechanical, F.col("rule")).alias("rule"),
        *(F.when(internal & ~mechanical, flags[b]).alias(b) for b in QUALITY_BUCKETS),
    )
    return judged.agg(
        F.count(F.lit(1)).alias("total_links"),
        count_if(F.col("internal")).alias("internal_links"),
        count_if(F.col("valid") & ~F.col("internal")).alias("external_links"),
        count_if(F.col("rule").isNotNull()).alias("mechanical_links"),
        count_if(F.col("editorial")).alias("editorial_links"),
        count_if(~F.col("valid")).alias("errors"),
        *(count_if(F.col("rule") == r).alias(f"rule_{r}") for r in RULES),
        *(count_if(F.col(b)).alias(b) for b in QUALITY_BUCKETS),
    )


FUNNEL = ("total_links", "internal_links", "external_links", "mechanical_links", "editorial_links", "errors")


def link_funnel(classified: DataFrame) -> DataFrame:
    """Totals over all links of an export, classified or not worth classifying."""
    return funnel_of(link_figures(classified))


def funnel_of(figures: DataFrame) -> DataFrame:
    share = ratio(F.col("editorial_links"), F.col("internal_links"), 100.0)
    return figures.select(*FUNNEL, share.alias("editorial_ratio"))


def rules_of(figures: DataFrame) -> DataFrame:
    """Mechanical links per rule that fired."""
    counts = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"rule_{r}").alias("links")) for r in RULES))
    return figures.select(F.explode(counts).alias("c")).select("c.*").where("links > 0")


def score_of(figures: DataFrame) -> DataFrame:
    """Editorial score with the counts it comes from."""
    share = ratio(F.col("editorial_links"), F.col("total_internal_links"), 100.0)
    counts = figures.withColumnRenamed("internal_links", "total_internal_links").withColumn("editorial_ratio", share)
    score = score_expression(
        *(F.col(c) for c in ("editorial_links", "editorial_ratio", "too_short", "too_long", "good")),
        F.col("keyword_stuffed"),
        F.col("url_anchor"),
    )
    return counts.select(
        "total_internal_links", "editorial_links", *QUALITY_BUCKETS, "editorial_ratio", score.alias("score")
    ).withColumn("rating", score_rating(F.col("score")))


def stats_of(profile: DataFrame) -> DataFrame:
    """The figures of ``link_stats`` from a page profile, without another pass over the links."""
    sums = profile.agg(
        count_if(F.col("is_source")).alias("total_pages"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in
          (("internal_out", "total_internal_links"), ("outlinks", "editorial_links"))),
    )
    return _with_ratios(
        sums.withColumn("mechanical_links", F.col("total_internal_links") - F.col("editorial_links"))
    )


def _with_ratios(stats: DataFrame) -> DataFrame:
    return stats.withColumn(
        "avg_editorial_per_page", ratio(F.col("editorial_links"), F.col("total_pages"))
    ).withColumn("editorial_ratio", ratio(F.col("editorial_links"), F.col("total_internal_links"), 100.0))


def link_stats(internal: DataFrame) -> DataFrame:
    """Figures over classified internal links."""
    return _with_ratios(
        internal.agg(
            F.count_distinct("source").alias("total_pages"),
            F.count(F.lit(1)).alias("total_internal_links"),
            count_if(~F.col("is_mechanical")).alias("editorial_links"),
            count_if(F.col("is_mechanical")).alias("mechanical_links"),
        )
    )


def rule_breakdown(internal: DataFrame) -> DataFrame:
    return internal.where("is_mechanical").groupBy("rule").agg(F.count(F.lit(1)).alias("links"))


def editorial_yield(matched: DataFrame, crawled: DataFrame, site: str) -> DataFrame:
    """Share of crawled links that an editorial match kept, and how many stay on the site."""
    kept = matched.select(F.lit(1).alias("kept"), F.col("destination").startswith(site).alias("on_site"))
    seen = crawled.select(F.lit(0).alias("kept"), F.lit(False).alias("on_site"))
    return (
        kept.unionByName(seen)
        .agg(
            count_if(F.col("kept") == 1).alias("editorial_links"),
            count_if(F.col("on_site")).alias("internal_editorial_links"),
            count_if(F.col("kept") == 0).alias("crawled_links"),
        )
        .withColumn("yield_percent", ratio(F.col("editorial_links"), F.col("crawled_links"), 100.0))
    )


# --- counts per key: partial sums before the shuffle ---------------------------


def outlink_counts(internal: DataFrame) -> DataFrame:
    return editorial(internal).groupBy("source").agg(F.count(F.lit(1)).alias("links"))


def inlink_counts(internal: DataFrame) -> DataFrame:
    return editorial(internal).groupBy("destination").agg(F.count(F.lit(1)).alias("links"))


def anchor_counts(internal: DataFrame) -> DataFrame:
    """Editorial links per anchor, blank anchors left out, case kept."""
    return (
        editorial(internal)
        .select(py_strip(F.col("anchor")).alias("anchor"))
        .where("anchor <> ''")
        .groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def over_repeated_anchors(anchors: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    return anchors.where(F.col("links") > cfg.max_anchor_repetition)


def top_linking_pages(outlinks: DataFrame, n: int = 10) -> DataFrame:
    return top(outlinks, n, "links", "source")


def most_linked_pages(inlinks: DataFrame, n: int = 10) -> DataFrame:
    return top(inlinks, n, "links", "destination")


def top_anchors(anchors: DataFrame, n: int = 20) -> DataFrame:
    return top(anchors, n, "links", "anchor")


def domain_counts(links: DataFrame, n: int | None = 5) -> DataFrame:
    """Links per destination host."""
    counts = links.groupBy(url_host(F.col("destination")).alias("host")).agg(F.count(F.lit(1)).alias("links"))
    return top(counts, n, "links", "host") if n else counts


def destination_category_counts(internal: DataFrame) -> DataFrame:
    """Editorial links per destination category with their share in percent."""
    counts = (
        editorial(internal)
        .where("destination <> ''")
        .groupBy(destination_category(F.col("destination")).alias("category"))
        .agg(F.count(F.lit(1)).alias("links"))
    )
    # The window covers at most six rows, one per category.
    total = F.sum("links").over(Window.partitionBy(F.lit(1)))
    return counts.select("category", "links", (F.col("links") / total * 100.0).alias("share_percent"))


# --- anchor quality and score -----------------------------------------------------


def anchor_quality_counts(internal: DataFrame) -> DataFrame:
    """Editorial links per quality bucket, one row."""
    flags = quality_flags(F.col("anchor"))
    return editorial(internal).agg(*(count_if(flags[b]).alias(b) for b in QUALITY_BUCKETS))


def score_expression(
    editorial_links: Column,
    editorial_ratio: Column,
    too_short: Column,
    too_long: Column,
    good: Column,
    keyword_stuffed: Column,
    url_anchor: Column,
) -> Column:
    """Editorial score, 0 to 100, unrounded."""
    r, e = editorial_ratio, editorial_links
    base = F.when(r >= 70, 90).when(r >= 50, 70).when(r >= 30, 50).when(r >= 15, 30).otherwise(10)
    weight = base / F.lit(100.0)
    penalty = weight * (15 * (too_short / e) + 10 * (too_long / e) + 20 * (keyword_stuffed / e) + 25 * (url_anchor / e))
    bonus = F.least(F.lit(5.0), 10 * (good / e))
    volume = F.when(e < 50, 10).otherwise(0)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - penalty + bonus - volume))
    return F.when(e == 0, F.lit(0.0)).otherwise(bounded)


def editorial_score(classified: DataFrame) -> DataFrame:
    """Score with the counts it comes from, in one pass over the classified links."""
    return score_of(link_figures(classified))


def anchor_diversity(anchors: DataFrame) -> DataFrame:
    """Distinct lower-cased anchors per anchor, from a table of anchors longer than 3 characters."""
    lowered = anchors.where(F.length(py_strip(F.col("anchor"))) > 3).select(
        F.lower(py_strip(F.col("anchor"))).alias("a"), "links"
    )
    return lowered.agg(
        F.coalesce(F.sum("links"), F.lit(0)).alias("anchors"), F.count_distinct("a").alias("distinct_anchors")
    ).withColumn("diversity", ratio(F.col("distinct_anchors"), F.col("anchors")))
