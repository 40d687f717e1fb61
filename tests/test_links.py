import json

import pytest
from pyspark.sql import functions as F

from linkaudit.catalog.fixtures import fixture
from linkaudit.config import AuditConfig
from linkaudit.operators import aggregates as A
from linkaudit.operators import classify as C
from linkaudit.operators import content as N
from linkaudit.operators import filters as R
from linkaudit.operators import graph as G
from linkaudit.operators import keywords as K
from linkaudit.plans import audit
from linkaudit.sources.csv import canonical_links

S, D = "https://s.fr/a", "https://s.fr/b"

RULES = [
    ("guide bois", "Contenu", "/body/p/a", "", "editorial"),
    ("guide bois", "En-tête", "", "", "origin"),
    ("guide bois", "PIED DE PAGE", "", "", "origin"),
    ("guide bois", "", "", "Menu", "link_type"),
    ("guide bois", "", "", "menus", "editorial"),
    ("  Précédent ", "", "", "", "anchor_pattern"),
    ("PRÉCÉDENT", "", "", "", "anchor_pattern"),
    ("précédents", "", "", "", "editorial"),
    ("page 12", "", "", "", "anchor_pattern"),
    ("En savoir plus", "", "", "", "anchor_pattern"),
    ("1234", "", "", "", "anchor_pattern"),
    ("guide bois", "", "//ASIDE/a", "", "path"),
    ("guide bois", "", "//div[@role='banner']/a", "", "path"),
    ("guide bois", "", "//div[@class='stage']/a", "", "path"),
    ("TV", "", "", "", "editorial"),
    ("ab", "", "", "", "short_anchor"),
    ("", "", "", "", "short_anchor"),
    ("  ", "", "", "", "short_anchor"),
    ("www.s.fr", "", "", "", "url_anchor"),
    ("https://s.fr", "", "", "", "url_anchor"),
    ("voir https://s.fr", "", "", "", "editorial"),
]


@pytest.mark.parametrize("anchor,origin,path,kind,rule", RULES)
def test_rules(links_of, anchor, origin, path, kind, rule):
    row = C.classify_links(links_of([(S, D, anchor, origin, path, kind)])).first()
    assert (row.rule, row.is_mechanical) == (rule, rule != "editorial")


def test_default_patterns_and_selectors(links_of):
    rows = links_of([(S, D, "read more"), (S, D, "more"), (S, D, ""), (S, D, "»"), (S, D, "lien", "", "/x-zone/a")])
    bare = AuditConfig.bare()
    assert [r.rule for r in C.classify_links(rows, bare).collect()] == ["anchor_pattern"] * 4 + ["editorial"]
    own = bare.with_options(selectors=(".x-zone",))
    assert C.classify_links(rows, own).collect()[4].rule == "selector"


def test_config_file(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"mechanical_anchor_patterns": ["^x$"], "analysis_thresholds": {"max_anchor_repetition": 9},
                                "semantic_analysis": {"enable_semantic_analysis": True, "min_cluster_size": 4}}))
    cfg = AuditConfig.from_json(str(path))
    assert (cfg.anchor_patterns, cfg.max_anchor_repetition, cfg.min_cluster_size) == (("^x$",), 9, 4)
    assert cfg.selectors == AuditConfig.bare().selectors and cfg.enable_semantic_analysis
    with pytest.raises(ValueError):
        cfg.with_options(unknown=1)


def test_nulls_become_empty_text(spark):
    raw = spark.createDataFrame([(S, " " + D, None)], "Source string, Destination string, Ancrage string")
    row = canonical_links(raw).first()
    assert (row.destination, row.anchor, row.origin, row.path, row.link_type) == (D, "", "", "", "")


QUALITY = [
    ("abc", "too_short"), ("abcd", ""), ("deux mots", "good"), ("a b c d e f", "good"), ("a b c d e f g", ""),
    ("a b c d e f g h i", "too_long"), ("promo Promo PROMO bois", "good keyword_stuffed"), ("abc abc abc", "good"),
    ("bois bois", "good"), ("www.x", "url_anchor"), ("  ", ""),
]


@pytest.mark.parametrize("anchor,flags", QUALITY)
def test_quality_flags(spark, anchor, flags):
    df = spark.createDataFrame([(anchor,)], "a string")
    row = df.select(*(c.alias(n) for n, c in C.quality_flags(F.col("a")).items())).first()
    assert {n for n in row.asDict() if row[n]} == set(flags.split())


def expected_score(e, ratio, short=0, long=0, good=0, stuffed=0, url=0):
    if e == 0:
        return 0.0
    base = next(b for limit, b in ((70, 90), (50, 70), (30, 50), (15, 30), (-1, 10)) if ratio >= limit)
    p = base / 100
    score = base - p * (15 * short / e + 10 * long / e + 20 * stuffed / e + 25 * url / e)
    return max(0, min(100, score + min(5, 10 * good / e) - (10 if e < 50 else 0)))


@pytest.mark.parametrize("e", [0, 19, 49, 50])
@pytest.mark.parametrize("ratio", [0.0, 14.9, 15.0, 30.0, 50.0, 70.0, 100.0])
def test_score_formula(spark, e, ratio):
    for counts in ((0, 0, 0, 0, 0), (e, 0, 0, e, e), (1, 2, 3, 4, 5), (0, 0, e, 0, 0)):
        names = ("too_short", "too_long", "good", "keyword_stuffed", "url_anchor")
        row = spark.createDataFrame([(e, ratio, *counts)], "e long, r double, " + ", ".join(f"{n} long" for n in names))
        got = row.select(A.score_expression(F.col("e"), F.col("r"), *(F.col(n) for n in names))).first()[0]
        short, long, good, stuffed, url = counts
        assert got == pytest.approx(expected_score(e, ratio, short, long, good, stuffed, url))


def test_figures_of_empty_links(links_of):
    none = C.classify_links(links_of([(S, D, "x y")])).where("source = ''")
    stats = A.link_stats(none).first()
    assert (stats.total_pages, stats.editorial_ratio, stats.avg_editorial_per_page) == (0, 0.0, 0.0)
    assert A.editorial_score(none).first().score == 0.0
    assert A.link_funnel(none).first().editorial_ratio == 0.0


def test_expected_counts(spark, sf):
    classified = C.classify_links(canonical_links(fixture(spark, sf, "fx_links")))
    inner = R.internal_links(classified)
    funnel = A.link_funnel(classified).first()
    assert (funnel.total_links, funnel.internal_links, funnel.editorial_links) == (6000, 5638, 3857)
    rules = {r.rule: r.links for r in A.rule_breakdown(inner).collect()}
    assert rules == {"origin": 542, "anchor_pattern": 338, "path": 718, "short_anchor": 85, "url_anchor": 98}
    assert A.link_stats(inner).first().total_pages == 1469
    assert G.orphan_pages(inner).count() == 1274
    assert A.over_repeated_anchors(A.anchor_counts(inner)).count() == 151
    quality = A.anchor_quality_counts(inner).first()
    assert (quality.too_short, quality.keyword_stuffed) == (152, 70)


def test_invariants(spark, sf):
    inner = R.internal_links(C.classify_links(canonical_links(fixture(spark, sf, "fx_links"))))
    stats = A.link_stats(inner).first()
    assert stats.editorial_links + stats.mechanical_links == stats.total_internal_links
    profile = G.page_profile(inner)
    sums = profile.agg(*(F.sum(c).alias(c) for c in ("outlinks", "inlinks", "outbound", "inbound"))).first()
    assert sums.outlinks == sums.inlinks == stats.editorial_links
    assert sums.outbound == sums.inbound
    linked = C.editorial(inner).select(F.col("destination").alias("url"))
    assert G.orphan_pages(inner).join(linked, "url", "left_semi").isEmpty()


def test_orphans(links_of, spark):
    links = C.classify_links(links_of([(S, D, "vers b"), (D, D, "vers soi"), ("https://s.fr/c", S, "accueil"), ("https://s.fr/c", "https://s.fr/c", "soi même")]))
    assert {r.url for r in G.orphan_pages(links).collect()} == {S}
    assert {r.url for r in G.orphan_pages(links, ignore_self_links=True).collect()} == {S, "https://s.fr/c"}
    pages = spark.createDataFrame([("https://s.fr/z",), (D,)], "url string")
    assert {r.url for r in G.orphan_pages(links, pages).collect()} == {S, "https://s.fr/z"}


def test_hot_page_and_anchor(spark):
    """A third of all links lead to one page with one anchor: figures stay exact."""
    rows = spark.range(30000).select(
        F.concat(F.lit("https://s.fr/p"), (F.col("id") % 999).cast("string")).alias("source"),
        F.when(F.col("id") % 3 == 0, F.lit("https://s.fr/")).otherwise(F.concat(F.lit("https://s.fr/p"), (F.col("id") % 501).cast("string"))).alias("destination"),
        F.when(F.col("id") % 3 == 0, F.lit("page maison")).otherwise(F.concat(F.lit("texte "), F.col("id").cast("string"))).alias("anchor"),
        F.lit("").alias("origin"), F.lit("").alias("path"), F.lit("").alias("link_type"),
    )
    inner = R.internal_links(C.classify_links(rows))
    assert A.most_linked_pages(A.inlink_counts(inner), 1).first().links == 10000
    assert A.top_anchors(A.anchor_counts(inner), 1).first().links == 10000
    assert G.network_nodes(inner).first().inbound == 10000


def test_keyword_thresholds(spark):
    anchors = spark.createDataFrame(
        [("Chêne massif clair", 1), ("chêne massif, clair!", 1), ("bois", 1), ("voir le bois", 1), ("pin", 9)], "anchor string, links long"
    )
    got = {r.keyword: (r.kind, r.uses, round(r.score, 6)) for r in K.keyword_counts(anchors).collect()}
    assert got == {
        "chêne": ("word", 2, 3.0), "massif": ("word", 2, 3.2), "clair": ("word", 2, 3.0), "bois": ("word", 2, 2.8),
        "chêne massif": ("phrase", 2, 5.0), "massif clair": ("phrase", 2, 5.0), "chêne massif clair": ("long_phrase", 2, 8.0),
    }


@pytest.mark.parametrize("counts", [[5], [1, 2], [3, 1, 2], [4, 4, 1, 9], [7, 7, 7, 1, 2, 3]])
def test_upper_median(spark, counts):
    df = spark.createDataFrame([(f"u{i}", str(c)) for i, c in enumerate(counts)], "url string, word_count string")
    assert N.word_count_stats(N.word_counts(df)).first().median_words == sorted(counts)[len(counts) // 2]


def test_title_h1_last_value_wins(spark):
    titles = spark.createDataFrame([("u", "neuf titre", 2), ("u", "ancien", 1), ("v", "t", 1), ("", "x", 1)], "url string, title string, ord int")
    h1s = spark.createDataFrame([("u", " Neuf Titre ", 1), ("w", "h", 1)], "url string, h1 string, ord int")
    got = {r.url: r.status for r in N.title_h1_coherence(titles, h1s).collect()}
    assert got == {"u": "identical", "v": "missing_h1", "w": "missing_title"}


def test_clusters_without_column(spark):
    sizes = N.cluster_sizes(spark.createDataFrame([("u",), ("v",)], "url string"))
    assert [tuple(r) for r in sizes.collect()] == [("all_pages", 2)]


def test_similarity_without_column(spark):
    pairs = spark.createDataFrame([("u", "v")], "source string, target string")
    assert N.high_similarity_pairs(pairs).first().similarity == 1.0


@pytest.mark.parametrize(
    "typed,path",
    [("/blog/", "/blog"), ("blog", "/blog"), ("https://s.fr/blog/x/", "/blog/x"), ("https://s.fr/", "/https://s.fr"), ("/", ""), ("/a/b/c/d", ""), ("", "")],
)
def test_section_path(spark, typed, path):
    df = spark.createDataFrame([(typed,)], "s string")
    assert df.select(R.section_path(F.col("s"))).first()[0] == path


def test_prefix_only_site_filter(links_of):
    links = links_of([(S, "https://s.fr.evil.com/x", "a"), (S, "https://s.fr/x", "b"), (S, "/x", "c")])
    assert R.internal_by_domain(links, "s.fr").count() == 1
    assert R.internal_by_domain(links, "s.fr", strict=False).count() == 2


def test_audit_tables_equal_the_single_operators(spark, sf, tmp_path):
    classified = C.classify_links(canonical_links(fixture(spark, sf, "fx_links")))
    inner = R.internal_links(classified)
    tables = audit.link_tables(classified, work_path=str(tmp_path))
    single = {
        "funnel": A.link_funnel(classified), "stats": A.link_stats(inner), "score": A.editorial_score(classified),
        "rules": A.rule_breakdown(inner), "orphan_pages": G.orphan_pages(inner),
        "top_linking_pages": A.top_linking_pages(A.outlink_counts(inner)),
        "most_linked_pages": A.most_linked_pages(A.inlink_counts(inner)),
    }
    for name, want in single.items():
        got = tables[name].select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), name


def test_audit_with_a_work_path(spark, sf, tmp_path):
    links = canonical_links(fixture(spark, sf, "fx_links"))
    tables = audit.audit_tables(links, cfg=AuditConfig().with_options(enable_semantic_analysis=False), work_path=str(tmp_path))
    assert audit.read_base(spark, str(tmp_path)).count() == 6000
    assert tables["orphan_pages"].count() == 1274
    simple = audit.simple_audit(links)
    assert simple["funnel"].first().total_links == 6000


def test_guided_audit(spark, sf):
    links = canonical_links(fixture(spark, sf, "fx_links"))
    cfg = AuditConfig().with_options(enable_semantic_analysis=False)
    tables = audit.guided_audit(links, fixture(spark, sf, "fx_link_pages"), "www.shop.example", "/blog", cfg)
    kept = tables["editorial_links"]
    assert 0 < kept.count() < links.count()
    assert kept.where("NOT (contains(source, '/blog') OR contains(destination, '/blog'))").isEmpty()
    assert tables["editorial_yield"].first().editorial_links == kept.count()
