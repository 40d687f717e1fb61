"""Sitemaps and robots files held in tables or files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import py_strip
from ..session import checkpoint_dir, cut_lineage


def _locations(xml: Column, within: str) -> Column:
    """Texts of ``<loc>`` elements inside elements named ``within``; namespace prefixes are allowed."""
    return F.regexp_extract_all(
        xml, F.lit(rf"(?s)<(?:\w+:)?{within}\b[^>]*>(?:(?!</(?:\w+:)?{within}>).)*?<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1)
    )


def _page_locations(xml: Column) -> Column:
    in_urls = _locations(xml, "url")
    anywhere = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1))
    return F.when(F.size(in_urls) > 0, in_urls).otherwise(anywhere)


def _is_index(xml: Column) -> Column:
    return xml.rlike(r"(?s)<(?:\w+:)?sitemap\b[^>]*>")


def read_sitemap(documents: DataFrame) -> DataFrame:
    """Page URLs of sitemap documents ``(sitemap_url, xml)``; an index itself lists no pages."""
    return (
        documents.where(~_is_index(F.col("xml")))
        .select("sitemap_url", F.explode(_page_locations(F.col("xml"))).alias("url"))
        .withColumn("url", py_strip(F.col("url")))
        .where(F.col("url").startswith("http"))
    )


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """Page URLs of sitemap files, plain or compressed, one document each, by the built-in XML reader (one row per ``<url>``).

    Namespaces do not matter, whether they are a default or have a prefix.
    """
    rows = spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", True).schema("loc string").load(path)
    return rows.select(py_strip(F.col("loc")).alias("url")).where(F.col("url").startswith("http"))


def expand_sitemap_index(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """``(sitemap_url, depth)`` of all sitemaps reached from ``roots (sitemap_url)`` through indexes.

    Breadth first, one equi-join per level over a parent -> child table that is made once. Each level is added to a table
    by depth, which is all that is written: a sitemap once. Each is entered once, so indexes that name each other end, and the
    loop goes on until a level is empty, however deep the indexes are.
    """
    spark = documents.sparkSession
    children = cut_lineage(
        documents.where(_is_index(F.col("xml")))
        .select(F.col("sitemap_url").alias("parent"), F.explode(_locations(F.col("xml"), "sitemap")).alias("sitemap_url"))
        .withColumn("sitemap_url", py_strip(F.col("sitemap_url")))
        .where("sitemap_url <> ''")
        .distinct()
    )
    known = documents.select("sitemap_url").distinct()
    # of the children that a level can enter, those that are documents are looked up once
    entered = cut_lineage(children.join(known, "sitemap_url", "left_semi"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/sitemaps-{uuid.uuid4().hex}"
    level = roots.select("sitemap_url").distinct().join(known, "sitemap_url", "left_semi")
    depth = 0
    while True:
        level.write.parquet(f"{folder}/depth={depth}")
        reached = spark.read.schema("sitemap_url string, depth int").parquet(folder)
        found = spark.read.schema("sitemap_url string").parquet(f"{folder}/depth={depth}")
        if found.isEmpty():
            return reached
        depth += 1
        parents = found.select(F.col("sitemap_url").alias("parent"))
        level = entered.join(parents, "parent").select("sitemap_url").distinct().join(reached, "sitemap_url", "left_anti")


def sitemap_pages(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """Page URLs of all sitemaps reached from ``roots``."""
    reached = expand_sitemap_index(documents, roots)
    return read_sitemap(documents.join(reached, "sitemap_url", "left_semi"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """``(robots_url, position, sitemap_url)`` for the sitemap lines of ``(robots_url, body)``."""
    return (
        robots.select("robots_url", F.posexplode(F.split("body", "\n")).alias("position", "line"))
        .where(F.lower("line").contains("sitemap"))
        .select(
            "robots_url",
            "position",
            py_strip(F.element_at(F.split("line", ": "), F.lit(2))).alias("sitemap_url"),
        )
        .where("sitemap_url IS NOT NULL AND sitemap_url <> ''")
    )
