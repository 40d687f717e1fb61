"""Nothing is cut off: deep sitemaps, large samples, medians over all pages, patterns of every kind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkaudit.functions.text import matches_any
from linkaudit.operators import content, sampling
from linkaudit.sources import attributes, sitemap


def test_a_chain_of_thirty_indexes_is_followed_to_its_end(spark):
    index = "<sitemapindex><sitemap><loc>s{}</loc></sitemap></sitemapindex>"
    rows = [(f"s{i}", index.format(i + 1)) for i in range(30)] + [("s30", "<urlset><url><loc>http://x/page</loc></url></urlset>")]
    documents = spark.createDataFrame(rows, "sitemap_url string, xml string")
    roots = spark.createDataFrame([("s0",)], "sitemap_url string")
    reached = sitemap.expand_sitemap_index(documents, roots).collect()
    assert sorted((r.depth, r.sitemap_url) for r in reached) == sorted((i, f"s{i}") for i in range(31))
    assert [r.url for r in sitemap.sitemap_pages(documents, roots).collect()] == ["http://x/page"]


def test_large_samples_keep_page_types_apart(spark):
    urls = [(i, f"https://x.fr/blog/article-{i:05d}") for i in range(2500)] + [(i, f"https://x.fr/produit/p{i:05d}") for i in range(2500)]
    out = sampling.sample_pages(spark.createDataFrame(urls, "ord int, url string"), "https://x.fr", max_samples=6000).orderBy("ord").collect()
    kinds = [r.page_type for r in out[1:]]
    assert len(out) == 2400 and sum(a != b for a, b in zip(kinds, kinds[1:])) == 1


@pytest.mark.parametrize("values", [[], [5], [1, 2], [3, 1, 2], [7] * 9, [0, 70_000, 140_000, 2_000_000_000], list(range(300_000, 0, -977))])
def test_upper_median(spark, values):
    table = spark.createDataFrame([("u", v) for v in values], "url string, word_count int")
    got = content.word_count_stats(content.word_counts(table)).first()
    assert got.median_words == (sorted(values)[len(values) // 2] if values else None)
    assert got.total_pages == len(values) and got.avg_words == (np.mean(values) if values else None)


@pytest.mark.parametrize(
    "patterns, text, expected",
    [
        ((r"^(foo)$", r"^(\w+) \1$"), "ha ha", True),
        ((r"^(foo)$", r"^(\w+) \1$"), "ha ho", False),
        ((r"(?-i:ABC)", "xyz"), "abc", False),
        ((r"(?-i:ABC)", "xyz"), "XYZ", True),
        ((r"(?<a>o)x\k<a>", r"(?<a>u)x\k<a>"), "uxu", True),
        (("^a|b$", "^c"), "xb", True),
    ],
)
def test_patterns_are_tested_one_by_one_where_joining_changes_them(spark, patterns, text, expected):
    assert spark.range(1).select(matches_any(F.lit(text), patterns)).first()[0] is expected


def test_alt_texts_may_count_in_full(spark):
    table = spark.createDataFrame([("u", "alt " * 200)], "url string, images_alt string")
    wide = table.withColumns({a: F.lit("") for a in attributes.TEXT_ATTRIBUTES if a != "images_alt"})
    assert len(attributes.page_text(wide).first().content) == 200
    assert len(attributes.page_text(wide, alt_text_chars=None).first().content) == 800
