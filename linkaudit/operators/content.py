"""Page content: word counts, title against H1, conversion pages, given clusters and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import AuditConfig
from ..functions.text import jaccard_words, py_strip, text
from .aggregates import count_if, ratio, top
from .classify import conversion_category, word_count_band


def word_counts(table: DataFrame) -> DataFrame:
    """``(url, word_count)`` from counts held as text; unreadable and negative cells are skipped."""
    count = py_strip(text(F.col("word_count").cast("string"))).try_cast("int")
    return (
        table.select("url", count.alias("word_count"))
        .where("url <> '' AND word_count >= 0")
        .withColumn("band", word_count_band(F.col("word_count")))
    )


#: Word counts are counted by their upper bits first: 2 ** 15 groups of 2 ** 16 counts each hold every int.
_COUNTS_IN_GROUP = 1 << 16


def _upper_median(counts: DataFrame) -> DataFrame:
    """One row ``median_words``: the upper median, from counts of groups and then of the values of one group.

    Neither the sums over groups nor those over the values of a group grow with the pages.
    """
    rows = counts.where("word_count IS NOT NULL").select("word_count", F.floor(F.col("word_count") / _COUNTS_IN_GROUP).alias("part"))
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.floor(F.sum("n").over(all_parts) / 2) + 1
    placed = parts.select("part", (place - F.sum("n").over(upto) + F.col("n")).alias("left"), F.col("n").alias("size"))
    middle = placed.where("left BETWEEN 1 AND size").select("part", "left")
    values = rows.join(middle, "part").groupBy("word_count").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
    below = Window.orderBy("word_count").rowsBetween(Window.unboundedPreceding, 0)
    reached = values.select("word_count", "left", F.sum("n").over(below).alias("upto")).where("upto >= left")
    return reached.agg(F.min("word_count").cast("int").alias("median_words"))


def word_count_stats(counts: DataFrame) -> DataFrame:
    """Pages, mean, upper median, extremes and band sizes, one row."""
    n = F.col("word_count")
    stats = counts.agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.avg(n).alias("avg_words"),
        F.min(n).alias("min_words"),
        F.max(n).alias("max_words"),
        *(count_if(F.col("band") == b).alias(f"{b}_pages") for b in ("thin", "quality", "rich")),
    )
    # both sides are one row
    return stats.select("*", _upper_median(counts).scalar().alias("median_words")).select(
        "total_pages", "avg_words", "median_words", "min_words", "max_words", "thin_pages", "quality_pages", "rich_pages"
    )


def _last_value(name: str) -> Column:
    here = F.col("attr") == name
    return F.coalesce(F.max_by(F.when(here, F.col("value")), F.when(here, F.col("ord"))), F.lit(""))


def title_h1_coherence(titles: DataFrame, h1s: DataFrame) -> DataFrame:
    """``(url, title, h1, status)`` for every URL of either table.

    ``titles (url, title[, ord])`` and ``h1s (url, h1[, ord])``: blank cells are left out, the last
    value per URL by ``ord`` wins (the greatest, without ``ord``). Both tables meet in one grouping
    by URL, which takes the place of two groupings and a full outer join.
    """

    def rows(df: DataFrame, value: str) -> DataFrame:
        order = F.col("ord") if "ord" in df.columns else F.col(value)
        return df.where((F.col("url") != "") & (F.col(value) != "")).select(
            "url", F.lit(value).alias("attr"), F.col(value).alias("value"), order.alias("ord")
        )

    both = rows(titles, "title").unionByName(rows(h1s, "h1"))
    merged = both.groupBy("url").agg(_last_value("title").alias("title"), _last_value("h1").alias("h1"))
    return merged.withColumn("status", title_h1_status(F.col("title"), F.col("h1")))


def title_h1_status(title: Column, h1: Column) -> Column:
    same = F.lower(py_strip(title)) == F.lower(py_strip(h1))
    return (
        F.when(title == "", F.lit("missing_title"))
        .when(h1 == "", F.lit("missing_h1"))
        .when(same, F.lit("identical"))
        .when(jaccard_words(title, h1) > 0.7, F.lit("similar"))
        .otherwise(F.lit("different"))
    )


def title_h1_summary(coherence: DataFrame) -> DataFrame:
    statuses = ("identical", "similar", "different", "missing_h1", "missing_title")
    return coherence.agg(
        count_if(F.col("status").isin(*statuses[:3])).alias("pages_with_both"),
        *(count_if(F.col("status") == s).alias(s) for s in statuses),
    )


def conversion_pages(pages: DataFrame) -> DataFrame:
    """``(url, title, category)`` of the pages that ask visitors for an action."""
    return (
        pages.select("url", "title")
        .withColumn("category", conversion_category(F.col("url"), F.col("title")))
        .where("category IS NOT NULL")
    )


def conversion_summary(pages: DataFrame, prefix: str = "") -> DataFrame:
    """Conversion pages per category, and all of them as a share of the whole table.

    The share stays relative to the whole table when a prefix narrows the pages.
    """
    category = conversion_category(F.col("url"), F.col("title"))
    if prefix:
        category = F.when(F.col("url").startswith(prefix), category)
    # Grouping keeps the rows without category too: their count completes the total. The windows
    # cover at most eight rows, one per category.
    counts = pages.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("pages"))
    everything = Window.partitionBy(F.lit(1))
    found = F.sum(F.when(F.col("category").isNotNull(), F.col("pages"))).over(everything)
    return counts.select(
        "category",
        "pages",
        found.alias("conversion_pages"),
        (found / F.sum("pages").over(everything) * 100.0).alias("share_percent"),
    ).where("category IS NOT NULL")


def high_similarity_pairs(pairs: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Given pairs ``(source, target, similarity)`` at or above the threshold; unreadable scores are skipped.

    Pairs without a score column count as certain.
    """
    score = F.col("similarity").try_cast("double") if "similarity" in pairs.columns else F.lit(1.0)
    return pairs.select("source", "target", score.alias("similarity")).where(
        (F.col("source") != "") & (F.col("target") != "") & (F.col("similarity") >= cfg.similarity_threshold)
    )


def similar_pairs_summary(high: DataFrame) -> DataFrame:
    return high.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("similarity").alias("avg_similarity"),
        F.max("similarity").alias("max_similarity"),
    )


def top_similar_pairs(high: DataFrame, n: int = 50) -> DataFrame:
    return top(high, n, "similarity", "source", "target")


def top_similarity_scores(high: DataFrame, n: int = 10) -> DataFrame:
    return high.select("similarity").orderBy(F.desc("similarity")).limit(n)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Pages per given cluster. Without a cluster column all pages form one cluster."""
    if "cluster_id" in clusters.columns:
        cluster = F.coalesce(F.col("cluster_id").cast("string"), F.lit("unclustered"))
    else:
        cluster = F.lit("all_pages")
    return clusters.groupBy(cluster.alias("cluster_id")).agg(F.count(F.lit(1)).alias("pages"))


def cluster_summary(sizes: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    return sizes.agg(
        F.count(F.lit(1)).alias("total_clusters"),
        count_if(F.col("pages") >= cfg.min_cluster_size).alias("meaningful_clusters"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("clustered_pages"),
    ).withColumn("avg_cluster_size", ratio(F.col("clustered_pages"), F.col("total_clusters")))


def largest_clusters(sizes: DataFrame, cfg: AuditConfig = AuditConfig(), n: int = 10) -> DataFrame:
    return top(sizes.where(F.col("pages") >= cfg.min_cluster_size), n, "pages", "cluster_id")
