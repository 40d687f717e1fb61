"""Pages as nodes, editorial links as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import AuditConfig
from ..functions.text import py_strip, truncate
from ..functions.urls import url_label
from .classify import editorial


def page_profile(internal: DataFrame, ignore_self_links: bool = False) -> DataFrame:
    """One row per URL of the internal links, from one scan and one shuffle.

    ``internal_out`` counts all links a page holds, ``outlinks`` and ``inlinks`` the editorial ones,
    ``outbound`` and ``inbound`` those without self links; ``is_source`` marks pages that hold any.
    Every link adds one row per end, and
    these are summed before the shuffle, so a page that holds a third of all links costs no more
    than another.
    """
    kept = ~F.col("is_mechanical")
    between = kept & (F.col("source") != F.col("destination"))
    counted_in = between if ignore_self_links else kept
    no, yes = F.lit(0), F.lit(1)

    def flag(condition):
        return F.when(condition, yes).otherwise(no)

    ends = F.array(
        F.struct(
            F.col("source").alias("url"), yes.alias("internal_out"), flag(kept).alias("outlinks"), no.alias("inlinks"),
            flag(between).alias("outbound"), no.alias("inbound"),
        ),
        F.struct(
            F.col("destination").alias("url"), no.alias("internal_out"), no.alias("outlinks"),
            flag(counted_in).alias("inlinks"), no.alias("outbound"), flag(between).alias("inbound"),
        ),
    )
    return (
        internal.select(F.explode(ends).alias("end"))
        .select("end.*")
        .groupBy("url")
        .agg(
            (F.sum("internal_out") > 0).alias("is_source"),
            *(F.sum(c).alias(c) for c in ("internal_out", "outlinks", "inlinks", "outbound", "inbound")),
        )
    )


def orphan_pages(
    internal: DataFrame, pages: DataFrame | None = None, ignore_self_links: bool = False
) -> DataFrame:
    """Pages that hold internal links but receive no editorial one.

    ``pages (url)`` adds pages that hold no link at all. ``ignore_self_links`` keeps a page from
    being rescued by its own link.
    """
    profile = page_profile(internal, ignore_self_links).select("url", "is_source", "inlinks")
    if pages is not None:
        listed = pages.select("url", F.lit(True).alias("is_source"), F.lit(0).cast("bigint").alias("inlinks"))
        profile = (
            profile.unionByName(listed)
            .groupBy("url")
            .agg(F.max("is_source").alias("is_source"), F.sum("inlinks").alias("inlinks"))
        )
    return orphans_of(profile)


def orphans_of(profile: DataFrame) -> DataFrame:
    return profile.where("is_source AND inlinks = 0").select("url")


def network_nodes(internal: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """The best connected pages with their degrees and a display label."""
    return nodes_of(page_profile(internal), cfg)


def nodes_of(profile: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    return (
        profile.where("inbound + outbound > 0")
        .orderBy(F.desc(F.col("inbound") + F.col("outbound")), "url")
        .limit(cfg.network_nodes)
        .select(F.col("url").alias("id"), "inbound", "outbound", url_label(F.col("url")).alias("label"))
    )


def network_edges(internal: DataFrame, nodes: DataFrame) -> DataFrame:
    """Editorial links between two of the kept nodes; anchors cut for display.

    ``nodes`` may be of any size: Spark broadcasts it if its size allows.
    """
    ids = nodes.select("id")
    return (
        editorial(internal)
        .where("source <> '' AND destination <> '' AND source <> destination")
        .join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "destination"), "destination", "left_semi")
        .select("source", F.col("destination").alias("target"), truncate(py_strip(F.col("anchor")), 50).alias("anchor"))
    )


def network_edge_list(edges: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """The edges a display shows: the first by source, target and anchor."""
    return edges.orderBy("source", "target", "anchor").limit(cfg.network_edges)


def linked_similar_filter(pairs: DataFrame, links: DataFrame, exclude_linked: bool = True) -> DataFrame:
    """Similar pairs ``(source, target, ...)`` of which neither page links to the other.

    Repeated links between two pages are reduced to one before the join.
    """
    if not exclude_linked:
        return pairs
    low, high = F.least("source", "target"), F.greatest("source", "target")
    linked = links.select(
        F.least("source", "destination").alias("low"), F.greatest("source", "destination").alias("high")
    ).distinct()
    return (
        pairs.withColumn("low", low).withColumn("high", high).join(linked, ["low", "high"], "left_anti").drop("low", "high")
    )
