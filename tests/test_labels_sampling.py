import random

import pytest
from pyspark.sql import functions as F

from linkaudit.operators import classify as C
from linkaudit.operators import labels as L
from linkaudit.operators import sampling as S


def expected(link, labels):
    """The label that the rules, read literally, pick for a link."""
    source, destination, anchor = link
    pages = []
    for label in sorted(labels, key=lambda x: x[5]):
        if label[0] not in pages:
            pages.append(label[0])
    page = next((p for p in pages if source.startswith(p.split("?")[0])), None)
    text, url = anchor.lower().strip(), destination.lower().strip()
    for label in sorted((x for x in labels if x[0] == page), key=lambda x: x[5]):
        other, href = label[2].lower().strip(), label[1].lower().strip()
        if text == other or ((text in other or other in text) and url.endswith(href.split("/")[-1])):
            return label
    return None


def test_overrides_follow_the_rules(spark, links_of):
    rng = random.Random(3)
    words = ["bois", "bois clair", "Clair", "", "pin", "accueil", "12"]
    urls = ["https://s.fr/a/bois", "https://s.fr/b/", "https://s.fr/clair", "/x/bois", "clair"]
    pages = ["https://s.fr/p", "https://s.fr/p1?x=1", "https://s.fr/p1?x=2", "https://s.fr/q"]
    labels = [
        (rng.choice(pages), rng.choice(urls), rng.choice(words), rng.choice(["EDITORIAL", "NAVIGATION", "CALL_TO_ACTION"]), i / 100, i)
        for i in range(25)
    ]
    links = [(f"https://s.fr/{s}", rng.choice(urls), rng.choice(words)) for s in ("p", "p1", "p12", "q?y", "r") for _ in range(30)]
    table = spark.createDataFrame(labels, "page_url string, href string, text string, category string, confidence double, ord int")
    got = L.apply_label_overrides(C.classify_links(links_of(links)), table)
    assert got.count() == len(links)
    for r in got.collect():
        label = expected((r.source, r.destination, r.anchor), labels)
        was = r.rule != "editorial"
        editorial = label is not None and label[3] in ("EDITORIAL", "CALL_TO_ACTION")
        flip = label is not None and was == editorial
        assert (r.label_corrected, r.is_mechanical) == (flip, was != flip)
        assert (r.label_category, r.label_confidence) == ((label[3], label[4]) if flip else (None, None))


def test_without_order_the_longest_page_wins(spark):
    labels = spark.createDataFrame(
        [("https://s.fr/", "x", "t", "EDITORIAL", 1.0), ("https://s.fr/p?x", "x", "t", "EDITORIAL", 1.0)],
        "page_url string, href string, text string, category string, confidence double",
    )
    sources = spark.createDataFrame([("https://s.fr/p?y",), ("https://s.fr/z",), ("https://t.fr/",)], "source string")
    got = {r.source: r.page_url for r in L.label_page_of_sources(sources, labels).collect()}
    assert got == {"https://s.fr/p?y": "https://s.fr/p?x", "https://s.fr/z": "https://s.fr/"}
    same = {r.source: r.page_url for r in L.label_page_of_sources(sources, labels, "page").collect()}
    assert same == {"https://s.fr/p?y": "https://s.fr/p?x"}


@pytest.mark.parametrize(
    "counts,samples,quotas",
    [
        ((9, 9, 9, 9, 0), 4, (1, 1, 1, 1, 0)),
        ((9, 0, 0, 0, 0), 4, (1, 0, 0, 0, 0)),
        ((9, 9, 0, 9, 0), 20, (4, 4, 0, 6, 0)),
        ((1, 1, 1, 1, 0), 2, (1, 1, 0, 0, 0)),
        ((0, 0, 0, 0, 0), 4, (0, 0, 0, 0, 0)),
    ],
)
def test_quotas(counts, samples, quotas):
    assert tuple(S._quotas(dict(zip(S.SAMPLING_ORDER, counts)), samples).values()) == quotas


def test_sample_pages(spark):
    urls = spark.createDataFrame(
        [("https://s.fr/",), ("https://s.fr/blog/b",), ("https://s.fr/blog/a",), ("https://s.fr/produit/x",), ("https://s.fr/contact",), ("https://s.fr/x",)],
        "url string",
    )
    got = [r.url for r in S.sample_pages(urls, "https://s.fr").orderBy("ord").collect()]
    assert got == ["https://s.fr/", "https://s.fr/blog/a", "https://s.fr/produit/x", "https://s.fr/contact"]
    inside = [r.url for r in S.sample_pages(urls, "https://s.fr", section="/blog").orderBy("ord").collect()]
    assert inside == ["https://s.fr/", "https://s.fr/blog/a"]
    other = [r.url for r in S.sample_pages(urls, "https://s.fr", section="/none").orderBy("ord").collect()]
    assert other == got


def test_labels_of_other_hosts_cost_no_rows(spark):
    def rows_of_joins(n_other):
        labels = [("https://s.fr/p", 0)] + [(f"https://other{i}.fr/{'x' * i}", i) for i in range(n_other)]
        table = spark.createDataFrame(labels, "page_url string, ord int")
        sources = spark.createDataFrame([(f"https://s.fr/p{i}",) for i in range(50)], "source string")
        found = L.label_page_of_sources(sources, table)
        assert len(found.collect()) == 50
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        lengths = table.selectExpr("regexp_extract(page_url, '^[^/]*//[^/]+/', 0) AS host", "length(page_url) AS n")
        return sources.selectExpr("regexp_extract(source, '^[^/]*//[^/]+/', 0) AS host").join(lengths, "host").count()

    assert rows_of_joins(0) == rows_of_joins(60) == 50


def test_alt_text_stands_for_an_empty_anchor(spark, links_of):
    labels = spark.createDataFrame(
        [("https://s.fr/p", "https://s.fr/x", "logo du site", "NAVIGATION", 0.9, 0)],
        "page_url string, href string, text string, category string, confidence double, ord int",
    )
    links = links_of([("https://s.fr/p", "https://s.fr/y/other", " ")])
    rows = L.match_labels(
        links.selectExpr("source", "'logo du site' AS text", "destination AS url"), labels
    ).collect()
    assert [r.category for r in rows] == ["NAVIGATION"]
    plain = L.apply_label_overrides(C.classify_links(links), labels).first()
    assert plain.label_category is None and plain.is_mechanical
    editorial = C.classify_links(links).withColumn("is_mechanical", F.lit(False))
    with_alt = L.apply_label_overrides(editorial.withColumn("alt_text", F.lit("Logo du site")), labels).first()
    assert (with_alt.label_category, with_alt.is_mechanical) == ("NAVIGATION", True)


def _moved(df):
    """Exchanges of rows in the plan of the last step."""
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")


@pytest.mark.parametrize(
    "ordered,page_match,few,compared",
    [(True, "prefix", 256, 5_000_000), (False, "prefix", 256, 0), (False, "prefix", 4, 5_000_000), (True, "page", 4, 5_000_000), (False, "page", 256, 5_000_000)],
)
def test_pages_of_few_and_of_many_labels(spark, links_of, monkeypatch, ordered, page_match, few, compared):
    """Labels that travel with their page and those matched by sweeps give the same; null URLs and texts, pages with queries and pages of others."""
    rng = random.Random(5)
    words = ["bois", " Bois Clair", "clair", "", "pin", None]
    urls = ["https://s.fr/a/bois", "https://s.fr/b/", "clair", "/x/Bois ", None]
    pages = ["https://s.fr/p", "https://s.fr/p1?x=1", "https://s.fr/p1?x=2", "https://s.fr/q", "https://s.fr/q?z", None]
    kinds = ["EDITORIAL", "NAVIGATION", "CALL_TO_ACTION", None]
    labels = [(rng.choice(pages), rng.choice(urls), rng.choice(words), rng.choice(kinds), i / 100, rng.choice([i, None])) for i in range(40)]
    table = spark.createDataFrame(labels, "page_url string, href string, text string, category string, confidence double, ord int")
    table = table if ordered else table.drop("ord")
    rows = [(f"https://s.fr/{s}", rng.choice(urls), rng.choice(words)) for s in ("p", "p1", "p12?a", "q?y", "r") for _ in range(20)] + [(None, urls[0], "bois")]
    links = C.classify_links(links_of(rows)).withColumn("is_mechanical", F.coalesce("is_mechanical", F.lit(True)))
    monkeypatch.setattr(L, "LABELS_AT_ONCE", few)
    monkeypatch.setattr(L, "COMPARED_AT_ONCE", compared)
    got = L.apply_label_overrides(links, table, page_match)
    keys = links.withColumn("text", F.btrim(F.lower("anchor"))).withColumn("url", F.btrim(F.lower("destination")))
    plain = keys.join(L.match_labels(keys, table, page_match), ["source", "text", "url"], "left").select(
        "source", "destination", "anchor", "is_mechanical", F.when(F.col("is_mechanical") == F.col("category").isin(*L.EDITORIAL_CATEGORIES), F.struct("category", "confidence")).alias("label")
    )
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(((r.source, r.destination, r.anchor, r.is_mechanical != (r.label is not None), *(r.label or (None, None))) for r in plain.collect()), key=key)
    have = sorted(((r.source, r.destination, r.anchor, r.is_mechanical, r.label_category, r.label_confidence) for r in got.collect()), key=key)
    assert have == want and any(r[4] for r in have)


def test_links_and_labels_move_once(spark, links_of):
    labels = spark.createDataFrame(
        [(f"https://s.fr/{i:02d}", "x", "bois", "EDITORIAL", 1.0) for i in range(50)], "page_url string, href string, text string, category string, confidence double"
    )
    links = C.classify_links(links_of([(f"https://s.fr/{i:02d}", "/x", "Bois") for i in range(60)])).withColumn("is_mechanical", F.lit(True))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        corrected = L.apply_label_overrides(links, labels)
        assert _moved(corrected) == 2
        counts = L.correction_counts(corrected)
        assert [tuple(r) for r in counts.collect()] == [("EDITORIAL", 50)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
