"""A small, varied choice of pages from a URL list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .classify import page_type

#: Page types in the order in which they are served (fixed values).
SAMPLING_ORDER = ("specific_or_article", "product", "contact", "section", "other")


def dedupe_urls(urls: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct URLs in order of first appearance by ``ord``, at most ``n``."""
    distinct = urls.groupBy("url").agg(F.min("ord").alias("ord"))
    return distinct.orderBy("ord", "url").limit(n) if n else distinct


def _quotas(counts: dict[str, int], samples: int) -> dict[str, int]:
    """Pages to take per type: an even share of what is left for the types still to come, at least one."""
    left, quotas = samples, {}
    for i, kind in enumerate(SAMPLING_ORDER):
        have = counts.get(kind, 0)
        quotas[kind] = min(have, max(1, left // (len(SAMPLING_ORDER) - i))) if have and left > 0 else 0
        left -= quotas[kind]
    return quotas


def strategic_selection(urls: DataFrame, samples: int) -> DataFrame:
    """``(kind, position, url)``: the first URLs of each page type up to its quota.

    Only five counts come to the driver. The ranking keeps ``samples`` URLs per type and task
    before the shuffle, so a type that holds most URLs is no bottleneck.
    """
    kind = page_type(F.col("url"))
    group = F.when(kind.isin("article", "specific"), F.lit(SAMPLING_ORDER[0])).otherwise(kind)
    typed = urls.select("url").distinct().withColumn("kind", group)
    counts = {r.kind: r.n for r in typed.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = _quotas(counts, samples)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("url"))
    ranked = typed.withColumn("position", rank).where(F.col("position") <= samples)
    keep = F.lit(False)
    for name, quota in quotas.items():
        if quota:
            keep = keep | ((F.col("kind") == name) & (F.col("position") <= quota))
    return ranked.where(keep).select("kind", "position", "url")


def sample_pages(urls: DataFrame, site: str, max_samples: int = 5, section: str = "") -> DataFrame:
    """``(ord, url, page_type)``: the homepage, then pages of every type, at most ``max_samples``.

    With a section that any URL belongs to, up to four pages come from it alone.
    """
    home = site.rstrip("/") + "/"
    pool, wanted = urls, max_samples - 1
    if section:
        inside = urls.where(F.col("url").contains(section))
        size = inside.select("url").distinct().limit(4).count()
        if size:
            pool, wanted = inside, min(size, max_samples - 1, 4)
    chosen = strategic_selection(pool, wanted)
    served = F.array_position(F.array(*(F.lit(k) for k in SAMPLING_ORDER)), F.col("kind"))
    # positions end at ``wanted``, so types keep apart whatever the sample size
    listed = chosen.select((served * (wanted + 1) + F.col("position")).cast("int").alias("ord"), "url")
    first = urls.sparkSession.range(1).select(F.lit(0).alias("ord"), F.lit(home).alias("url"))
    return dedupe_urls(first.unionByName(listed), max_samples).select(
        "ord", "url", page_type(F.col("url")).alias("page_type")
    )
