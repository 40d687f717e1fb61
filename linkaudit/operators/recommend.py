"""Recommendations: what to repair, with priority, one row per finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import AuditConfig
from ..functions.text import py_strip
from ..session import cut_lineage, stored
from .aggregates import anchor_counts, anchor_quality_counts, over_repeated_anchors, stats_of, top
from .classify import editorial, quality_flags
from .graph import orphans_of, page_profile

COLUMNS = ("kind", "priority", "url", "problem", "recommendation", "details")
WHOLE_SITE = "whole site"


def _one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", value)


def _finding(*values) -> Column:
    """One row of the recommendation table as a struct."""
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast("string").alias(c) for c, v in zip(COLUMNS, values)))


def _found(df: DataFrame, *findings: tuple[Column, Column]) -> DataFrame:
    """The findings ``(condition, struct)`` that hold for each row: several kinds from one pass."""
    structs = F.array_compact(F.array(*(F.when(condition, finding) for condition, finding in findings)))
    return df.select(F.explode(structs).alias("finding")).select("finding.*")


def anchor_findings(internal: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Too short, stuffed and URL anchors: up to three rows per editorial link.

    ``flagged``: the editorial links with these flags, if there are any already.
    """
    quoted = F.concat(F.lit("'"), py_strip(F.col("anchor")), F.lit("'"))
    url = F.col("destination")
    if flagged is None:
        flags = quality_flags(F.col("anchor"))
        flagged = editorial(internal).select(
            "destination", "anchor", *(flags[f].alias(f) for f in ("too_short", "keyword_stuffed", "url_anchor"))
        )
    return _found(
        flagged,
        (
            F.col("too_short"),
            _finding("weak anchor", "medium", url, F.concat(F.lit("anchor too short: "), quoted),
                     "use a more descriptive anchor", F.concat(F.lit("current anchor: "), quoted)),
        ),
        (
            F.col("keyword_stuffed"),
            _finding("stuffed anchor", "high", url, F.concat(F.lit("anchor repeats its keywords: "), quoted),
                     "vary with natural phrases", "risk of a search penalty"),
        ),
        (
            F.col("url_anchor"),
            _finding("unoptimised anchor", "medium", url, F.concat(F.lit("URL used as anchor: "), quoted),
                     "replace by a descriptive anchor", "URLs make poor anchors"),
        ),
    )


def site_findings(stats: DataFrame, cfg: AuditConfig = AuditConfig(), site: str | None = None) -> DataFrame:
    """Low editorial share and thin linking of the whole site, from the one-row figures."""
    share, density = F.col("editorial_ratio"), F.col("avg_editorial_per_page")
    where = site or WHOLE_SITE
    return _found(
        stats,
        (
            share < cfg.min_editorial_ratio,
            _finding("overall strategy", "high", where,
                     F.concat(F.lit("low editorial share ("), _one_decimal(share), F.lit("%)")),
                     "add editorial links to the contents", f"less than {cfg.min_editorial_ratio:g}% editorial links"),
        ),
        (
            density < cfg.min_links_per_page,
            _finding("link density", "medium", where,
                     F.concat(F.lit("too few links ("), _one_decimal(density), F.lit(" links/page)")),
                     "aim at 2-3 editorial links per page", "internal linking below optimum"),
        ),
    )


def recommendations(
    internal: DataFrame,
    cfg: AuditConfig = AuditConfig(),
    site: str | None = None,
    profile: DataFrame | None = None,
    anchors: DataFrame | None = None,
    flagged: DataFrame | None = None,
) -> DataFrame:
    """All findings over classified internal links.

    Orphans and site figures share the page profile, which is made once. Pass a profile, anchor
    counts or flagged anchors already made to save their passes; without them the columns that all findings read are stored once, so that links are
    classified in one pass.
    """
    if profile is None or anchors is None:
        internal = stored(internal.select("source", "destination", "anchor", "is_mechanical"), "internal")
    profile = cut_lineage(page_profile(internal)) if profile is None else profile
    anchors = anchor_counts(internal) if anchors is None else anchors
    orphans, stats = orphans_of(profile), stats_of(profile)
    uses = F.col("links").cast("string")
    always = F.lit(True)
    orphan = _finding("orphan page", "high", F.col("url"), "no editorial link leads here",
                      "create contextual editorial links", "page outside the editorial linking")
    repeated = _finding("repeated anchor", "medium", "multiple",
                        F.concat(F.lit("anchor used "), uses, F.lit(" times: '"), F.col("anchor"), F.lit("'")),
                        "vary the wording", F.concat(F.lit("excessive repetition ("), uses, F.lit(" uses)")))
    parts = [
        _found(orphans, (always, orphan)),
        anchor_findings(internal, flagged),
        _found(over_repeated_anchors(anchors, cfg), (always, repeated)),
        site_findings(stats, cfg, site),
    ]
    return reduce(DataFrame.unionByName, parts)


def priority_advice(
    internal: DataFrame,
    cfg: AuditConfig = AuditConfig(),
    profile: DataFrame | None = None,
    quality: DataFrame | None = None,
) -> DataFrame:
    """Up to four lines of advice, each with the figure that calls for it."""
    profile = cut_lineage(page_profile(internal)) if profile is None else profile
    orphans, stats = orphans_of(profile), stats_of(profile)
    quality = anchor_quality_counts(internal) if quality is None else quality

    def lines(df: DataFrame, *wanted) -> DataFrame:
        structs = (
            F.when(
                condition,
                F.struct(
                    F.lit(position).alias("position"), F.lit(advice).alias("advice"),
                    F.col(figure).cast("double").alias("figure"),
                ),
            )
            for position, advice, figure, condition in wanted
        )
        return df.select(F.explode(F.array_compact(F.array(*structs))).alias("line")).select("line.*")

    parts = [
        lines(orphans.agg(F.count(F.lit(1)).alias("n")), (1, "link orphan pages", "n", F.col("n") > 0)),
        lines(
            stats,
            (2, "raise the editorial share", "editorial_ratio", F.col("editorial_ratio") < cfg.min_editorial_ratio),
            (4, "add editorial links", "avg_editorial_per_page",
             F.col("avg_editorial_per_page") < cfg.min_links_per_page),
        ),
        lines(quality, (3, "describe short anchors", "too_short", F.col("too_short") > 0)),
    ]
    return reduce(DataFrame.unionByName, parts)


def missing_link_recommendations(high: DataFrame, n: int = 20) -> DataFrame:
    """The most similar given pairs as links to add."""
    similarity = F.col("similarity")
    return top(high, n, "similarity", "source", "target").select(
        F.col("source").alias("source_page"),
        F.col("target").alias("target_page"),
        similarity.alias("similarity_score"),
        F.concat(F.lit("editorial link recommended (similarity: "), F.format_string("%.3f", similarity), F.lit(")")).alias(
            "recommendation"
        ),
        F.when(similarity > 0.9, F.lit("high")).otherwise(F.lit("medium")).alias("priority"),
    )


def pillar_page_recommendations(sizes: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Clusters large enough for a page that introduces them."""
    pages = F.col("pages")
    return sizes.where((pages >= cfg.min_cluster_size) & (pages >= 5)).select(
        F.col("cluster_id").alias("cluster"),
        pages.alias("pages_count"),
        F.concat(
            F.lit("create a pillar page for cluster '"), F.col("cluster_id"), F.lit("' ("), pages.cast("string"), F.lit(" pages)")
        ).alias("recommendation"),
        F.when(pages > 10, F.lit("high")).otherwise(F.lit("medium")).alias("priority"),
    )
