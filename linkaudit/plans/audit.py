"""Whole audits: one classified link table, a few shared profiles, many result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import AuditConfig
from ..functions.text import truncate
from ..operators import aggregates as agg
from ..operators import content as cnt
from ..operators import graph, keywords, pages as pg, recommend, similarity, themes as th
from ..operators.classify import anchor_quality, classify_links, classify_links_simple, editorial
from ..operators.filters import internal_links, url_prefix_filter, valid_links
from ..session import cut_lineage, shuffles_dropped
from ..sources.attributes import page_text


@dataclass
class PageInputs:
    """Optional tables beside the links; each adds its part of the audit."""

    word_counts: DataFrame | None = None  # (url, word_count)
    titles: DataFrame | None = None  # (url, title[, ord])
    h1s: DataFrame | None = None  # (url, h1[, ord])
    internal_pages: DataFrame | None = None  # (url, title)
    similar_pairs: DataFrame | None = None  # (source, target, similarity)
    clusters: DataFrame | None = None  # (url, cluster_id)
    attributes: DataFrame | None = None  # one row per URL, a column per attribute


def base_links(links: DataFrame, cfg: AuditConfig = AuditConfig(), prefix: str = "", simple: bool = False) -> DataFrame:
    """Links under the prefix with their class: one narrow plan from the scan on."""
    chosen = url_prefix_filter(links, prefix) if prefix else links
    return classify_links_simple(chosen) if simple else classify_links(chosen, cfg)


def shared(df: DataFrame, name: str, work_path: str | None) -> DataFrame:
    """A table that several others start from, made once.

    With a ``work_path`` it becomes a Parquet table there, which lets each later pass read only the columns it needs;
    without one it is written to the checkpoint folder. Both outlive executors.
    """
    if work_path is None:
        return cut_lineage(df)
    target = f"{work_path.rstrip('/')}/{name}"
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target)


def classified_links(
    links: DataFrame, cfg: AuditConfig = AuditConfig(), prefix: str = "", work_path: str | None = None
) -> DataFrame:
    """The classified links that all tables start from."""
    return shared(base_links(links, cfg, prefix), "classified_links", work_path)


def link_tables(
    classified: DataFrame, cfg: AuditConfig = AuditConfig(), site: str | None = None, work_path: str | None = None
) -> dict[str, DataFrame]:
    """Every table about links. All counts come from one pass; pages and anchors are each grouped once."""
    internal = internal_links(classified)
    profile = shared(graph.page_profile(internal), "page_profile", work_path)
    anchors = shared(agg.anchor_counts(internal), "anchor_counts", work_path)
    figures = shared(agg.link_figures(classified), "link_figures", work_path)
    nodes = shared(graph.nodes_of(profile, cfg), "network_nodes", work_path)
    flags = ("too_short", "keyword_stuffed", "url_anchor")
    flagged = shared(anchor_quality(internal).where(" OR ".join(flags)).select("anchor", "destination", *flags), "flagged_anchors", work_path)
    edges = graph.network_edge_list(graph.network_edges(internal, nodes), cfg)
    outlinks = profile.where("outlinks > 0").select(F.col("url").alias("source"), F.col("outlinks").alias("links"))
    inlinks = profile.where("inlinks > 0").select(F.col("url").alias("destination"), F.col("inlinks").alias("links"))
    return {
        "funnel": agg.funnel_of(figures),
        "stats": agg.stats_of(profile),
        "score": agg.score_of(figures),
        "rules": agg.rules_of(figures),
        "top_linking_pages": agg.top_linking_pages(outlinks),
        "most_linked_pages": agg.most_linked_pages(inlinks),
        "top_anchors": agg.top_anchors(anchors),
        "over_repeated_anchors": agg.over_repeated_anchors(anchors, cfg),
        "orphan_pages": graph.orphans_of(profile),
        "flagged_anchors": flagged,
        "destination_categories": agg.destination_category_counts(internal),
        "anchor_keywords": keywords.anchor_keywords(anchors, cfg),
        "network_nodes": nodes,
        "network_edges": edges,
        "recommendations": recommend.recommendations(internal, cfg, site, profile, anchors, flagged),
        "priority_advice": recommend.priority_advice(internal, cfg, profile, figures),
    }


def content_tables(inputs: PageInputs, cfg: AuditConfig = AuditConfig(), prefix: str = "") -> dict[str, DataFrame]:
    """Tables about pages, for the inputs that are there."""

    def under(df: DataFrame, column: str = "url") -> DataFrame:
        return df.where(F.col(column).startswith(prefix)) if prefix else df

    out: dict[str, DataFrame] = {}
    if inputs.word_counts is not None:
        counts = cnt.word_counts(under(inputs.word_counts))
        out["word_count_stats"] = cnt.word_count_stats(counts)
        out["thin_pages"] = counts.where("band = 'thin'").select("url", "word_count")
    if inputs.titles is not None and inputs.h1s is not None:
        coherence = cnt.title_h1_coherence(under(inputs.titles), under(inputs.h1s))
        out["title_h1_summary"] = cnt.title_h1_summary(coherence)
        out["title_h1_different"] = coherence.where("status = 'different'").select(
            "url", truncate(F.col("title"), 60).alias("title"), truncate(F.col("h1"), 60).alias("h1")
        )
    if inputs.internal_pages is not None:
        out["conversion_pages"] = cnt.conversion_pages(under(inputs.internal_pages))
        out["conversion_summary"] = cnt.conversion_summary(inputs.internal_pages, prefix)
    if cfg.enable_semantic_analysis and inputs.similar_pairs is not None:
        high = cnt.high_similarity_pairs(under(inputs.similar_pairs, "source"), cfg)
        out["similar_pairs_summary"] = cnt.similar_pairs_summary(high)
        out["similar_pairs"] = cnt.top_similar_pairs(high)
        out["similarity_scores"] = cnt.top_similarity_scores(high)
        out["missing_links"] = recommend.missing_link_recommendations(high)
    if cfg.enable_semantic_analysis and inputs.clusters is not None:
        sizes = cnt.cluster_sizes(under(inputs.clusters))
        out["cluster_summary"] = cnt.cluster_summary(sizes, cfg)
        out["largest_clusters"] = cnt.largest_clusters(sizes, cfg)
        out["pillar_pages"] = recommend.pillar_page_recommendations(sizes, cfg)
    return out


def semantic_tables(
    classified: DataFrame,
    attributes: DataFrame | None = None,
    encoder=similarity.hashed_vector,
    work_path: str | None = None,
) -> dict[str, DataFrame]:
    """Themes of anchors; with page attributes also the fit of anchors and pages worth linking, those without a link yet."""
    internal = internal_links(classified)
    themes = shared(th.cluster_themes(agg.anchor_counts(internal), encoder=encoder), "themes", work_path)
    out = {"theme_names": th.name_themes(themes), "theme_words": th.theme_words(themes)}
    if attributes is not None:
        coherence = similarity.anchor_coherence(internal, page_text(attributes), encoder=encoder)
        out["coherence_summary"] = similarity.coherence_summary(coherence)
        contents = page_text(attributes, alt_texts=False).where("content <> ''")
        vectors = contents.select(F.col("url").alias("id"), encoder(F.col("content")).alias("embedding"))
        out["link_opportunities"] = similarity.unlinked_similar_pairs(shared(vectors, "page_vectors", work_path), internal)
    return out


def audit_tables(
    links: DataFrame,
    inputs: PageInputs = PageInputs(),
    cfg: AuditConfig = AuditConfig(),
    prefix: str = "",
    site: str | None = None,
    work_path: str | None = None,
) -> dict[str, DataFrame]:
    """The data behind every section of an audit report, by name."""
    classified = classified_links(links, cfg, prefix, work_path)
    tables = link_tables(classified, cfg, site, work_path)
    tables.update(content_tables(inputs, cfg, prefix))
    if cfg.enable_semantic_analysis:
        tables.update(semantic_tables(classified, inputs.attributes, work_path=work_path))
    return tables


def simple_audit(links: DataFrame) -> dict[str, DataFrame]:
    """The reduced audit: three rules, fixed thresholds, no content analysis."""
    classified = base_links(links, simple=True)
    internal = internal_links(classified)
    anchors = agg.anchor_counts(internal)
    return {
        "funnel": agg.link_funnel(classified),
        "stats": agg.link_stats(internal),
        "top_linking_pages": agg.top_linking_pages(agg.outlink_counts(internal)),
        "most_linked_pages": agg.most_linked_pages(agg.inlink_counts(internal)),
        "top_anchors": agg.top_anchors(anchors),
        "over_repeated_anchors": agg.over_repeated_anchors(anchors),
        "orphan_pages": graph.orphan_pages(internal),
    }


def guided_audit(
    links: DataFrame, pages: DataFrame, host: str, section: str = "", cfg: AuditConfig = AuditConfig(), **options
) -> dict[str, DataFrame]:
    """Links that the content zones of the page HTML confirm, then the audit of those links."""
    chosen = valid_links(links)
    if section:
        chosen = chosen.where(F.col("source").contains(section) | F.col("destination").contains(section))
    found = pg.match_editorial_links(chosen, pg.content_zone_links(pg.extract_page_links(pages)), host)
    confirmed = shared(found, "editorial_links", options.get("work_path"))  # the pages are parsed once
    tables = audit_tables(confirmed, cfg=cfg, **options)
    tables["editorial_links"] = confirmed
    tables["editorial_yield"] = agg.editorial_yield(confirmed, chosen, f"https://{host}")
    tables["domain_counts"] = agg.domain_counts(confirmed)
    return tables


def read_base(spark: SparkSession, path: str) -> DataFrame:
    """A classified link table written by an earlier audit."""
    return spark.read.parquet(f"{path.rstrip('/')}/classified_links")


__all__ = [
    "PageInputs", "audit_tables", "base_links", "classified_links", "content_tables", "editorial", "guided_audit",
    "link_tables", "read_base", "semantic_tables", "simple_audit",
]
