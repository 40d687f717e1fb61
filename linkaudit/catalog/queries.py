"""The registered queries: one Spark function per operator, over whole tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import AuditConfig
from ..functions import html as H
from ..functions.text import jaccard_words, ngrams, py_words, truncate
from ..functions.urls import url_host, url_join, url_label, url_path
from ..operators import aggregates as A
from ..operators import classify as C
from ..operators import content as N
from ..operators import filters as R
from ..operators import graph as G
from ..operators import keywords as K
from ..operators import labels as L
from ..operators import pages as P
from ..operators import recommend as M
from ..operators import sampling as S
from ..operators import similarity as V
from ..operators import themes as T
from ..plans import audit, folder
from ..session import checkpoint_dir
from ..sources import attributes, sinks, sitemap
from ..sources.csv import canonical_links, read_csv, read_links_csv
from .audited import digests
from .fixtures import HOST, SITE, fixture, register_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CFG = AuditConfig()


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def links(spark, sf) -> DataFrame:
    return canonical_links(fixture(spark, sf, "fx_links"))


def classified(spark, sf) -> DataFrame:
    return C.classify_links(links(spark, sf), CFG)


def internal(spark, sf) -> DataFrame:
    return R.internal_links(classified(spark, sf))


def scratch(spark, name: str) -> str:
    """A new folder next to the checkpoints, which all executors see."""
    return f"{checkpoint_dir(spark).rstrip('/')}/linkaudit-{name}-{uuid.uuid4().hex}"


def _r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


# --- sources and sinks ---------------------------------------------------------------


@query
def read_links_csv_export(spark, sf):
    folder = scratch(spark, "export")
    raw = fixture(spark, sf, "fx_links").select(
        F.col("source").alias(" Source "), F.col("destination").alias("Destination"), F.col("anchor").alias("Ancrage"),
        F.col("origin").alias("Origine du lien"), F.col("path").alias("Chemin du lien"),
    )
    raw.write.option("header", True).option("sep", ";").option("escape", '"').csv(folder)
    return read_links_csv(spark, folder)


@query
def read_links_csv_mixed(spark, sf):
    """All links as four exports of one folder, each written in another way, read back together."""
    folder = scratch(spark, "mixed")
    part = F.pmod(F.xxhash64("source", "destination", "anchor", "origin", "path"), F.lit(4))
    raw = fixture(spark, sf, "fx_links").withColumn("part", part)
    names = {"source": " Source ", "destination": "Destination", "anchor": "Ancrage", "origin": "Origine du lien", "path": "Chemin du lien"}
    forms = [(",", "UTF-8", list(names)), (";", "ISO-8859-1", list(names)), ("\t", "UTF-8", list(names)), (",", "UTF-8", [*reversed(names)])]
    for n, (sep, encoding, order) in enumerate(forms):
        rows = raw.where(F.col("part") == n).select(*(F.col(c).alias(names[c]) for c in order))
        writer = rows.write.option("header", True).option("sep", sep).option("encoding", encoding)
        writer.option("quoteAll", n == 3).option("escape", '"').mode("append").csv(folder)
    return read_links_csv(spark, folder)


@query
def load_page_attributes(spark, sf):
    wide = attributes.load_page_attributes(fixture(spark, sf, "fx_part_attrs"))
    return wide.select("url", *(F.coalesce(c, F.lit("")).alias(c) for c in wide.columns[1:]))


@query
def page_text(spark, sf):
    return attributes.page_text(attributes.load_page_attributes(fixture(spark, sf, "fx_part_attrs")))


@query
def read_sitemap(spark, sf):
    return sitemap.read_sitemap(fixture(spark, sf, "fx_sitemaps"))


@query
def expand_sitemap_index(spark, sf):
    documents = fixture(spark, sf, "fx_sitemaps")
    return sitemap.expand_sitemap_index(documents, documents.where("sitemap_url = 'https://maps.example/index.xml'"))


@query
def sitemap_pages(spark, sf):
    documents = fixture(spark, sf, "fx_sitemaps")
    return sitemap.sitemap_pages(documents, documents.where("sitemap_url = 'https://maps.example/index.xml'")).select("url")


@query
def read_sitemap_files(spark, sf):
    """All sitemaps as compressed files of well-formed XML with a namespace, read back by the XML reader."""
    folder = scratch(spark, "sitemaps")
    named = F.regexp_replace(F.replace("xml", F.lit("&"), F.lit("&amp;")), "^<(urlset|sitemapindex)>", '<$1 xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')
    files = fixture(spark, sf, "fx_sitemaps").select(named.alias("xml"), F.xxhash64("sitemap_url").alias("file"))
    files.write.option("compression", "gzip").partitionBy("file").text(folder)
    return sitemap.read_sitemap_files(spark, folder)


@query
def robots_sitemaps(spark, sf):
    return sitemap.robots_sitemaps(fixture(spark, sf, "fx_robots"))


@query
def write_recommendations(spark, sf):
    folder = scratch(spark, "recommendations")
    sinks.write_recommendations(M.recommendations(internal(spark, sf), CFG, SITE), folder)
    return read_csv(spark, folder)


@query
def write_editorial_links(spark, sf):
    folder = scratch(spark, "editorial")
    sinks.write_editorial_links(C.editorial(internal(spark, sf)).select("source", "destination", "anchor"), folder)
    return read_csv(spark, folder)


def page_inputs(spark, sf) -> audit.PageInputs:
    return audit.PageInputs(
        word_counts=fixture(spark, sf, "fx_word_counts"),
        titles=fixture(spark, sf, "fx_page_attrs").select("url", "title"),
        h1s=fixture(spark, sf, "fx_page_attrs").select("url", "h1"),
        internal_pages=fixture(spark, sf, "fx_internal_pages"),
        similar_pairs=fixture(spark, sf, "fx_similar_pairs"),
        clusters=fixture(spark, sf, "fx_clusters"),
        attributes=attributes.load_page_attributes(fixture(spark, sf, "fx_part_attrs")),
    )


@query
def audit_tables(spark, sf):
    """Rows and a digest of every table of an audit with semantic analysis."""
    cfg = CFG.with_options(enable_semantic_analysis=True)
    return digests(audit.audit_tables(links(spark, sf), page_inputs(spark, sf), cfg, site=SITE, work_path=scratch(spark, "audit")))


@query
def simple_audit(spark, sf):
    return digests(audit.simple_audit(links(spark, sf)))


@query
def guided_audit(spark, sf):
    """The links that page HTML confirms, and the audit of them."""
    pages = fixture(spark, sf, "fx_link_pages")
    cfg = CFG.with_options(enable_semantic_analysis=False)
    return digests(audit.guided_audit(links(spark, sf), pages, HOST, cfg=cfg, site=SITE, work_path=scratch(spark, "guided")))


@query
def semantic_tables(spark, sf):
    """Themes, coherence and opportunities of a site whose anchors vary."""
    varied = C.classify_links(canonical_links(fixture(spark, sf, "fx_varied_links")), CFG)
    wide = attributes.load_page_attributes(fixture(spark, sf, "fx_varied_attrs"))
    return digests(audit.semantic_tables(varied, wide, work_path=scratch(spark, "semantic")))


@query
def link_opportunities(spark, sf):
    """Similar pages without a link between them: every second one of the best pairs is linked beforehand."""
    vectors = fixture(spark, sf, "fx_page_vectors").select("id", "embedding")
    best = V.similar_page_pairs(vectors, limit=40)
    place = F.row_number().over(Window.orderBy(F.desc("similarity"), "source", "target"))  # of 40 rows
    linked = best.withColumn("n", place).where("n % 2 = 1").select(F.col("target").alias("source"), F.col("source").alias("destination"))
    return V.unlinked_similar_pairs(vectors, linked).select("source", "target", _r("similarity"))


@query
def audit_of_folder(spark, sf):
    """All families of exports, page attributes too, written to one folder, found by name, read by header and audited."""
    home = scratch(spark, "folder")
    attrs = fixture(spark, sf, "fx_part_attrs")
    headers = {"titles": "Title", "h1": "H1-1", "h2": "H2-1", "meta_desc": "Meta Description", "meta_keywords": "Meta Keywords", "images_alt": "Alt Text"}
    files = {"meta_desc": "meta_description", "images_alt": "images"}
    exports = {
        "all_outlinks.csv": fixture(spark, sf, "fx_links").select(
            F.col("source").alias("Source"), F.col("destination").alias("Destination"), F.col("anchor").alias("Ancrage"),
            F.col("origin").alias("Origine du lien"), F.col("path").alias("Chemin du lien")),
        "word_count.csv": fixture(spark, sf, "fx_word_counts").select(F.col("url").alias("Address"), F.col("word_count").alias("Word Count")),
        "page_titles_all.csv": fixture(spark, sf, "fx_page_attrs").select(F.col("url").alias("Address"), F.col("title").alias("Title 1")),
        "h1_all.csv": fixture(spark, sf, "fx_page_attrs").select(F.col("url").alias("Address"), F.col("h1").alias("H1-1")),
        "internal_html.csv": fixture(spark, sf, "fx_internal_pages").select(F.col("url").alias("Address"), F.col("title").alias("Title 1")),
        "similar_pages.csv": fixture(spark, sf, "fx_similar_pairs").select(
            F.col("source").alias("Source"), F.col("target").alias("Target"), F.col("similarity").cast("string").alias("Similarity")),
        "content_clusters.csv": fixture(spark, sf, "fx_clusters").select(F.col("url").alias("URL"), F.col("cluster_id").cast("string").alias("Cluster")),
        # the later row of a page wins: the rows of a page stand in their order
        **{f"all_outlinks_{files.get(a, a)}.csv": attrs.where(F.col("attr") == a).repartitionByRange("url").sortWithinPartitions("url", "ord").select(
            F.col("url").alias("Address"), F.col("value").alias(header)) for a, header in headers.items()},
    }
    for name, table in exports.items():
        # gzip files are read by one task each, so a large table is many files
        writer = table.write.option("compression", "gzip").option("maxRecordsPerFile", 500_000)
        writer = writer.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "")
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{home}/{name}")
    cfg = CFG.with_options(enable_semantic_analysis=True)
    return digests(folder.audit_of_folder(spark, home, "all_outlinks.csv", cfg, site=SITE, work_path=scratch(spark, "folder-audit")))


# --- filters -------------------------------------------------------------------------------


@query
def valid_links(spark, sf):
    return R.valid_links(links(spark, sf))


@query
def internal_links(spark, sf):
    return R.internal_links(links(spark, sf))


@query
def external_links(spark, sf):
    return R.external_links(links(spark, sf))


@query
def internal_by_domain(spark, sf):
    return R.internal_by_domain(links(spark, sf), HOST)


@query
def url_prefix_filter(spark, sf):
    return R.url_prefix_filter(links(spark, sf), SITE + "blog/")


@query
def page_prefix_filter(spark, sf):
    return R.page_prefix_filter(fixture(spark, sf, "fx_word_counts"), SITE + "guide/p1")


@query
def section_filter(spark, sf):
    return R.section_filter(links(spark, sf), "/blog")


@query
def section_path(spark, sf):
    urls = fixture(spark, sf, "fx_urls")
    path = F.element_at(F.split("url", "/"), -1)
    return urls.select("url", R.section_path(F.col("url")).alias("from_url"), R.section_path(path).alias("from_path"))


@query
def crawlable_urls(spark, sf):
    return R.crawlable_urls(fixture(spark, sf, "fx_urls"), HOST)


@query
def crawlable_urls_any_host(spark, sf):
    return R.crawlable_urls(fixture(spark, sf, "fx_urls"), "example", "sitemap")


@query
def crawlable_urls_shallow(spark, sf):
    return R.crawlable_urls(fixture(spark, sf, "fx_urls"), HOST, "shallow")


@query
def crawlable_urls_of_section(spark, sf):
    return R.crawlable_urls(fixture(spark, sf, "fx_urls"), HOST, "section", section="/blog")


@query
def site_url(spark, sf):
    return R.site_url(links(spark, sf))


# --- row-wise labels ---------------------------------------------------------------------


@query
def classify_links(spark, sf):
    return classified(spark, sf)


@query
def classify_links_default_patterns(spark, sf):
    return C.classify_links(links(spark, sf), AuditConfig.bare())


@query
def classify_links_simple(spark, sf):
    return C.classify_links_simple(links(spark, sf))


@query
def anchor_quality(spark, sf):
    return C.anchor_quality(internal(spark, sf)).select(
        "destination", "anchor", "too_short", "too_long", "good", "keyword_stuffed", "url_anchor"
    )


@query
def destination_category(spark, sf):
    return fixture(spark, sf, "fx_urls").select("url", C.destination_category(F.col("url")).alias("category"))


@query
def page_type(spark, sf):
    return fixture(spark, sf, "fx_urls").select("url", C.page_type(F.col("url")).alias("page_type"))


@query
def conversion_pages(spark, sf):
    return N.conversion_pages(fixture(spark, sf, "fx_internal_pages"))


@query
def word_count_band(spark, sf):
    return N.word_counts(fixture(spark, sf, "fx_word_counts"))


@query
def similarity_band(spark, sf):
    high = N.high_similarity_pairs(fixture(spark, sf, "fx_similar_pairs"), CFG.with_options(similarity_threshold=0.0))
    return high.groupBy(C.similarity_band(F.col("similarity")).alias("band")).agg(F.count(F.lit(1)).alias("pairs"))


# --- aggregations ----------------------------------------------------------------------------


@query
def link_funnel(spark, sf):
    return A.link_funnel(classified(spark, sf))


@query
def link_funnel_simple(spark, sf):
    return A.link_funnel(C.classify_links_simple(links(spark, sf)))


@query
def link_stats(spark, sf):
    return A.link_stats(internal(spark, sf))


@query
def rule_breakdown(spark, sf):
    return A.rule_breakdown(internal(spark, sf))


@query
def rule_breakdown_all_rules(spark, sf):
    """A configuration with own selectors and a pattern that refers to its group, on links with types: every rule occurs."""
    cfg = CFG.with_options(anchor_patterns=(*CFG.anchor_patterns, r"^(\w+) \1 \1 "), selectors=(".promo-box",))
    typed = fixture(spark, sf, "fx_links").withColumn("link_type", F.when(F.col("l_linenumber") == 6, "Footer").otherwise("Hyperlink"))
    boxed = typed.withColumn("path", F.when(F.col("l_linenumber") == 5, "/html/body/div.promo-box/a").otherwise(F.col("path")))
    return A.rule_breakdown(R.internal_links(C.classify_links(canonical_links(boxed), cfg)))


@query
def outlink_counts(spark, sf):
    return A.outlink_counts(internal(spark, sf))


@query
def inlink_counts(spark, sf):
    return A.inlink_counts(internal(spark, sf))


@query
def anchor_counts(spark, sf):
    return A.anchor_counts(internal(spark, sf))


@query
def over_repeated_anchors(spark, sf):
    return A.over_repeated_anchors(A.anchor_counts(internal(spark, sf)), CFG)


@query
def anchor_quality_counts(spark, sf):
    return A.anchor_quality_counts(internal(spark, sf))


@query
def editorial_score(spark, sf):
    scored = A.editorial_score(classified(spark, sf))
    return scored.withColumn("score", F.round("score", 6))


@query
def destination_category_counts(spark, sf):
    return A.destination_category_counts(internal(spark, sf))


@query
def keyword_counts(spark, sf):
    return K.keyword_counts(A.anchor_counts(internal(spark, sf)), CFG).withColumn("score", F.round("score", 6))


@query
def anchor_keywords(spark, sf):
    return K.anchor_keywords(A.anchor_counts(internal(spark, sf)), CFG).withColumn("score", F.round("score", 6))


@query
def word_count_stats(spark, sf):
    return N.word_count_stats(N.word_counts(fixture(spark, sf, "fx_word_counts")))


def _coherence(spark, sf):
    attrs = fixture(spark, sf, "fx_page_attrs")
    return N.title_h1_coherence(attrs.select("url", "title"), attrs.select("url", "h1"))


@query
def title_h1_coherence(spark, sf):
    return _coherence(spark, sf)


@query
def title_h1_summary(spark, sf):
    return N.title_h1_summary(_coherence(spark, sf))


@query
def conversion_summary(spark, sf):
    return N.conversion_summary(fixture(spark, sf, "fx_internal_pages"))


def _high(spark, sf):
    return N.high_similarity_pairs(fixture(spark, sf, "fx_similar_pairs"), CFG)


@query
def high_similarity_pairs(spark, sf):
    return _high(spark, sf)


@query
def similar_pairs_summary(spark, sf):
    return N.similar_pairs_summary(_high(spark, sf)).withColumn("avg_similarity", F.round("avg_similarity", 6))


@query
def top_similar_pairs(spark, sf):
    return N.top_similar_pairs(_high(spark, sf))


@query
def top_similarity_scores(spark, sf):
    return N.top_similarity_scores(_high(spark, sf))


@query
def cluster_summary(spark, sf):
    return N.cluster_summary(N.cluster_sizes(fixture(spark, sf, "fx_clusters")), CFG)


@query
def largest_clusters(spark, sf):
    return N.largest_clusters(N.cluster_sizes(fixture(spark, sf, "fx_clusters")), CFG)


@query
def domain_counts(spark, sf):
    return A.domain_counts(C.editorial(classified(spark, sf)))


@query
def editorial_yield(spark, sf):
    everything = classified(spark, sf)
    return A.editorial_yield(C.editorial(everything), everything, SITE)


@query
def anchor_diversity(spark, sf):
    return A.anchor_diversity(fixture(spark, sf, "fx_theme_anchors"))


# --- joins and sets ------------------------------------------------------------------------------


@query
def orphan_pages(spark, sf):
    return G.orphan_pages(internal(spark, sf))


@query
def orphan_pages_of_list(spark, sf):
    listed = R.page_prefix_filter(fixture(spark, sf, "fx_urls"), SITE)
    return G.orphan_pages(internal(spark, sf), pages=listed, ignore_self_links=True)


@query
def page_profile(spark, sf):
    return G.page_profile(internal(spark, sf))


@query
def linked_similar_filter(spark, sf):
    high = _high(spark, sf).select(
        F.regexp_replace("source", "/guide/", "/blog/").alias("source"),
        F.regexp_replace("target", "/guide/", "/produits/").alias("target"),
        "similarity",
    )
    return G.linked_similar_filter(high, internal(spark, sf))


def _content_links(spark, sf):
    return P.content_zone_links(P.extract_page_links(fixture(spark, sf, "fx_link_pages")))


@query
def match_editorial_links(spark, sf):
    kept = P.match_editorial_links(links(spark, sf), _content_links(spark, sf), HOST)
    return kept.select("source", "destination", "anchor")


@query
def apply_label_overrides(spark, sf):
    return L.apply_label_overrides(classified(spark, sf), fixture(spark, sf, "fx_labels"))


@query
def apply_label_overrides_same_page(spark, sf):
    return L.apply_label_overrides(classified(spark, sf), fixture(spark, sf, "fx_labels"), page_match="page")


@query
def correction_counts(spark, sf):
    return L.correction_counts(L.apply_label_overrides(classified(spark, sf), fixture(spark, sf, "fx_labels")))


@query
def network_nodes(spark, sf):
    return G.network_nodes(internal(spark, sf), CFG)


@query
def network_edges(spark, sf):
    kept = internal(spark, sf)
    return G.network_edges(kept, G.network_nodes(kept, CFG))


@query
def network_edge_list(spark, sf):
    kept = internal(spark, sf)
    edges = G.network_edges(kept, G.network_nodes(kept, CFG.with_options(network_nodes=1000)))
    return G.network_edge_list(edges, CFG)


@query
def recommendations(spark, sf):
    return M.recommendations(internal(spark, sf), CFG, SITE)


@query
def priority_advice(spark, sf):
    return M.priority_advice(internal(spark, sf), CFG.with_options(min_editorial_ratio=90.0, min_links_per_page=10.0))


@query
def missing_link_recommendations(spark, sf):
    return M.missing_link_recommendations(_high(spark, sf))


@query
def pillar_page_recommendations(spark, sf):
    return M.pillar_page_recommendations(N.cluster_sizes(fixture(spark, sf, "fx_clusters")), CFG)


# --- top lists and samples --------------------------------------------------------------------


@query
def top_linking_pages(spark, sf):
    return A.top_linking_pages(A.outlink_counts(internal(spark, sf)))


@query
def most_linked_pages(spark, sf):
    return A.most_linked_pages(A.inlink_counts(internal(spark, sf)))


@query
def top_anchors(spark, sf):
    return A.top_anchors(A.anchor_counts(internal(spark, sf)))


@query
def sample_pages(spark, sf):
    return S.sample_pages(R.crawlable_urls(fixture(spark, sf, "fx_urls"), HOST), SITE, 8)


@query
def sample_pages_of_section(spark, sf):
    return S.sample_pages(R.crawlable_urls(fixture(spark, sf, "fx_urls"), HOST), SITE, 5, "/expertise/")


@query
def dedupe_urls(spark, sf):
    seen = fixture(spark, sf, "fx_links").select(F.col("destination").alias("url"), F.col("l_orderkey").alias("ord"))
    return S.dedupe_urls(seen, 50)


# --- HTML ----------------------------------------------------------------------------------------


@query
def extract_page_links(spark, sf):
    return P.extract_page_links(register_table(spark, sf, "pages")).select("page_url", "position", "href", "text", "in_zone", "in_nav")


@query
def extract_page_links_own_parser(spark, sf):
    """The links of all pages by another parser than the library's own."""

    def parser():
        anchor = re.compile(r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>')
        return lambda html: ({"href": href, "text": text.strip(), "in_zone": True} for href, text in anchor.findall(html))

    return P.extract_page_links(register_table(spark, sf, "pages"), parser=parser)


@query
def extract_flat_links(spark, sf):
    return P.extract_flat_links(register_table(spark, sf, "pages"))


@query
def nav_zone(spark, sf):
    extracted = P.extract_page_links(fixture(spark, sf, "fx_nested_pages"))
    return P.nav_zone_links(extracted).select("page_url", "position", "href", "text", "context")


@query
def content_zone_links(spark, sf):
    extracted = P.extract_page_links(fixture(spark, sf, "fx_nested_pages"))
    return P.content_zone_links(extracted).select("page_url", "position", "href", "text", "context")


@query
def content_links_of_link_pages(spark, sf):
    return _content_links(spark, sf).select("page_url", "href", "text")


@query
def page_attributes(spark, sf):
    return P.page_attributes(register_table(spark, sf, "pages"))


@query
def clean_html(spark, sf):
    return register_table(spark, sf, "pages").select("url", H.clean_html(F.col("html")).alias("html"))


# --- expressions ---------------------------------------------------------------------------------


@query
def url_functions(spark, sf):
    url = F.col("url")
    return fixture(spark, sf, "fx_urls").select(
        "url", url_host(url).alias("host"), url_path(url).alias("path"), url_label(url).alias("label"),
        url_join(url, F.lit("/a/b")).alias("joined_root"), truncate(url, 20).alias("short"),
    )


@query
def text_functions(spark, sf):
    attrs = fixture(spark, sf, "fx_page_attrs")
    words = py_words(F.lower("title"))
    return attrs.select(
        "url", F.size(words).alias("n_words"), F.array_join(ngrams(words, 2), "|").alias("pairs"),
        F.array_join(ngrams(words, 3), "|").alias("triples"),
        F.round(jaccard_words(F.col("title"), F.col("h1")), 6).alias("jaccard"),
    )


# --- vectors and themes --------------------------------------------------------------------------


@query
def embed_texts(spark, sf):
    """Vectors of all texts; those of every other text, by its key, come from a cache."""
    texts = fixture(spark, sf, "fx_texts")
    cache = V.embed_texts(texts).where(F.substring("text_md5", 1, 1) < "8").select("text_md5", "embedding")
    embedded = V.embed_texts(texts, cache)
    return embedded.select("text_md5", F.concat_ws(",", F.transform("embedding", lambda x: x.cast("int").cast("string"))).alias("vector"), "cached")


@query
def embed_texts_cached(spark, sf):
    """The same through a stored cache, to which half of the texts are added twice, and once more by another audit."""
    path = scratch(spark, "cache")
    texts = fixture(spark, sf, "fx_texts")
    some = V.embed_texts(texts.where(F.md5("text") < "8"))
    for batch in (None, None, "another audit"):
        V.append_cache(some, path, batch)
    embedded = V.embed_texts(texts, V.read_cache(spark, path))
    return embedded.select("text_md5", F.concat_ws(",", F.transform("embedding", lambda x: x.cast("int").cast("string"))).alias("vector"), "cached")


@query
def embedding_cache_stats(spark, sf):
    return V.embedding_cache_stats(register_table(spark, sf, "embeddings"))


@query
def similar_page_pairs(spark, sf):
    pairs = V.similar_page_pairs(fixture(spark, sf, "fx_page_vectors").select("id", "embedding"))
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query
def anchor_coherence(spark, sf):
    contents = attributes.page_text(attributes.load_page_attributes(fixture(spark, sf, "fx_part_attrs")))
    return V.anchor_coherence(internal(spark, sf), contents).withColumn("similarity", F.round("similarity", 6))


@query
def coherence_summary(spark, sf):
    contents = attributes.page_text(attributes.load_page_attributes(fixture(spark, sf, "fx_part_attrs")))
    summary = V.coherence_summary(V.anchor_coherence(internal(spark, sf), contents))
    return summary.withColumn("average_score", F.round("average_score", 6))


@query
def density_clusters(spark, sf):
    points = fixture(spark, sf, "fx_page_vectors").select("id", "embedding", F.lit(1).cast("bigint").alias("weight"))
    return T.density_clusters(points, 0.2, 3).select("id", "is_core", "label")


def _themes(spark, sf):
    return T.cluster_themes(fixture(spark, sf, "fx_theme_anchors"), min_cluster_size=2)


@query
def cluster_themes(spark, sf):
    return _themes(spark, sf)


@query
def cluster_themes_dominant(spark, sf):
    """One subject holds nearly all anchors, so they are searched again with the smaller radius."""
    return T.cluster_themes(fixture(spark, sf, "fx_dominant_anchors"), min_cluster_size=2)


@query
def name_themes(spark, sf):
    return T.name_themes(_themes(spark, sf))


@query
def theme_words(spark, sf):
    return T.theme_words(_themes(spark, sf)).withColumn("size", F.round("size", 6))
