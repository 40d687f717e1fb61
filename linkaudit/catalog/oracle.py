"""SQL for DuckDB that states what each registered query must return."""

from __future__ import annotations

from ..config import (
    CONVERSION_CATEGORIES,
    DESTINATION_CATEGORIES,
    PAGE_TYPES,
    SKIPPED_URL_PARTS,
    STOP_WORDS,
    THEME_STOP_WORDS,
)
from .audited import digest_sql
from .fixtures import FIXTURES, HOST, SITE, duckdb_with

ORACLE: dict[str, str] = {}


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _contains(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def _case(expr: str, categories: dict, otherwise: str) -> str:
    whens = " ".join(f"WHEN {_contains(expr, words)} THEN '{name}'" for name, words in categories.items())
    return f"CASE {whens} ELSE {otherwise} END"


def _host(expr: str) -> str:
    return f"regexp_extract({expr}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def _path(expr: str) -> str:
    return f"regexp_extract({expr}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '[\\s\\x{{a0}}]+'), lambda w: w <> '')"


PATH_WORDS = (
    "header|footer|nav|menu|breadcrumb|pagination|pager|sidebar|widget|aside|social|share|partage|tag|category"
    "|categorie|related|connexe|similaire"
)
SHIPPED = (
    "^(accueil|home|menu|navigation)$|^(suivant|précédent|next|previous|page \\d+)$"
    "|^(lire la suite|en savoir plus|voir plus|read more)$|^(contact|à propos|mentions légales|cgv|politique)$"
    "|^\\d+$|^(cliquez ici|cliquer ici|ici|click here)$|^(retour|back|retour accueil)$"
)
BUILT_IN = SHIPPED.replace("read more)", "read more|more)").replace("politique)", "politique|privacy)").replace(
    "click here)", "click here|here)"
) + "|^(passer au contenu|skip to content)$|^(voir tout|see all|view all)$|^(\\+|-|>|<|»|«)$|^$"

INTERNAL = f"{_host('source')} = {_host('destination')}"
VALID = "trim(source) <> '' AND trim(destination) <> ''"


def _rules(patterns: str) -> str:
    return f"""CASE
    WHEN regexp_matches(lower(origin), 'navigation|en-tête|pied de page|header|footer|nav|menu') THEN 'origin'
    WHEN regexp_matches(trim(lower(anchor)), '{patterns}') THEN 'anchor_pattern'
    WHEN regexp_matches(lower(path), '{PATH_WORDS}') THEN 'path'
    WHEN length(trim(anchor)) <= 2 AND trim(lower(anchor)) NOT IN ('tv', 'pc') THEN 'short_anchor'
    WHEN regexp_matches(trim(lower(anchor)), '^(https?://|www\\.)') THEN 'url_anchor'
    ELSE 'editorial' END"""


SIMPLE_RULES = f"""CASE
    WHEN lower(origin) IN ('navigation', 'en-tête', 'pied de page') THEN 'origin'
    WHEN regexp_matches(trim(lower(anchor)), '{SHIPPED}|^(passer au contenu)$|^$') THEN 'anchor_pattern'
    WHEN regexp_matches(lower(path), 'header|footer|nav|menu|breadcrumb|pagination|sidebar|widget') THEN 'path'
    ELSE 'editorial' END"""


def _sql(*fixtures: str, ctes: str = "", body: str) -> str:
    head = duckdb_with(*fixtures) if fixtures else "WITH RECURSIVE unused AS (SELECT 1)"
    return head + (",\n" + ctes.strip() if ctes else "") + "\n" + body.strip()


CLASSES = f"""
cl AS (SELECT source, destination, anchor, origin, path, '' AS link_type, {_rules(SHIPPED)} AS rule FROM fx_links),
il AS (SELECT *, rule <> 'editorial' AS mech FROM cl WHERE {VALID} AND {INTERNAL}),
ed AS (SELECT * FROM il WHERE NOT mech)"""


def _links(body: str, *more: str, ctes: str = "") -> str:
    return _sql("fx_links", *more, ctes=CLASSES + (",\n" + ctes.strip() if ctes else ""), body=body)


LINK_COLUMNS = "source, destination, anchor, origin, path, '' AS link_type"

# --- sources and sinks ---------------------------------------------------------------

ORACLE["read_links_csv_export"] = _sql("fx_links", body=f"SELECT {LINK_COLUMNS} FROM fx_links")
ORACLE["read_links_csv_mixed"] = ORACLE["read_links_csv_export"]

_ATTRS = ("titles", "h1", "h2", "h3", "meta_desc", "meta_keywords", "images_alt", "schema_org")
WIDE = "wide AS (SELECT url, {} FROM fx_part_attrs WHERE trim(value) <> '' GROUP BY url)".format(
    ", ".join(f"coalesce(arg_max(trim(value), ord) FILTER (attr = '{a}'), '') AS {a}" for a in _ATTRS)
)
ORACLE["load_page_attributes"] = _sql("fx_part_attrs", ctes=WIDE, body="SELECT * FROM wide")
CONTENT = "contents AS (SELECT url, concat_ws(' ', {}, nullif(images_alt[:200], '')) AS content FROM wide)".format(
    ", ".join(f"nullif({a}, '')" for a in _ATTRS[:6])
)
ORACLE["page_text"] = _sql("fx_part_attrs", ctes=f"{WIDE}, {CONTENT}", body="SELECT * FROM contents")

ORACLE["read_sitemap"] = "SELECT concat('https://maps.example/s', page_id // 100, '.xml') AS sitemap_url, url FROM pages"
ORACLE["expand_sitemap_index"] = """
SELECT 'https://maps.example/index.xml' AS sitemap_url, 0 AS depth
UNION SELECT concat('https://maps.example/i', page_id // 1000, '.xml'), (page_id // 1000)::INTEGER + 1 FROM pages
UNION SELECT concat('https://maps.example/s', page_id // 100, '.xml'), (page_id // 1000)::INTEGER + 2 FROM pages"""
ORACLE["sitemap_pages"] = "SELECT url FROM pages"
ORACLE["read_sitemap_files"] = "SELECT url FROM pages"
ORACLE["robots_sitemaps"] = f"""
SELECT concat('https://', h, '/robots.txt') AS robots_url, p AS position, concat('https://', h, f) AS sitemap_url
FROM (SELECT DISTINCT {_host('url')} AS h FROM pages), (VALUES (2, '/sitemap.xml'), (3, '/news.xml')) v(p, f)"""

# --- filters -------------------------------------------------------------------------------

for _name, _where in {
    "valid_links": VALID,
    "internal_links": f"{VALID} AND {INTERNAL}",
    "external_links": f"{VALID} AND NOT ({INTERNAL})",
    "internal_by_domain": f"{_host('destination')} = '{HOST}'",
    "url_prefix_filter": f"starts_with(source, '{SITE}blog/') OR starts_with(destination, '{SITE}blog/')",
    "section_filter": "contains(source, '/blog') OR contains(destination, '/blog')",
}.items():
    ORACLE[_name] = _sql("fx_links", body=f"SELECT {LINK_COLUMNS} FROM fx_links WHERE {_where}")
ORACLE["page_prefix_filter"] = _sql(
    "fx_word_counts", body=f"SELECT * FROM fx_word_counts WHERE url LIKE '{SITE}guide/p1%'"
)


def _section(expr: str) -> str:
    rooted = f"rtrim(CASE WHEN trim({expr}) LIKE '/%' THEN trim({expr}) ELSE concat('/', trim({expr})) END, '/')"
    slashes = f"len({rooted}) - len(replace({rooted}, '/', ''))"
    return f"""CASE WHEN {expr} = '' THEN ''
      WHEN regexp_matches({expr}, '^https?://') AND rtrim({_path(expr)}, '/') <> '' THEN rtrim({_path(expr)}, '/')
      WHEN len({rooted}) > 1 AND {slashes} <= 3 THEN {rooted} ELSE '' END"""


ORACLE["section_path"] = _sql(
    "fx_urls",
    ctes="u AS (SELECT url, string_split(url, '/')[-1] AS tail FROM fx_urls)",
    body=f"SELECT url, {_section('url')} AS from_url, {_section('tail')} AS from_path FROM u",
)
ORACLE["crawlable_urls"] = _sql(
    "fx_urls",
    body=f"SELECT url FROM fx_urls WHERE contains(url, '{HOST}') AND NOT {_contains('lower(url)', SKIPPED_URL_PARTS['deep'])}",
)
ORACLE["crawlable_urls_any_host"] = _sql(
    "fx_urls",
    body=f"SELECT url FROM fx_urls WHERE contains(url, 'example') AND NOT {_contains('lower(url)', SKIPPED_URL_PARTS['sitemap'])}",
)
ORACLE["crawlable_urls_shallow"] = _sql(
    "fx_urls",
    body=f"SELECT url FROM fx_urls WHERE contains(url, '{HOST}') AND NOT {_contains('lower(url)', SKIPPED_URL_PARTS['shallow'])}",
)
ORACLE["crawlable_urls_of_section"] = _sql(
    "fx_urls",
    body=f"""SELECT url FROM fx_urls WHERE contains(url, '{HOST}') AND contains(url, '/blog')
    AND NOT {_contains('lower(url)', SKIPPED_URL_PARTS['section'])}""",
)
ORACLE["site_url"] = _sql(
    "fx_links",
    body="""SELECT regexp_extract(source, '^([a-z]+://[^/?#]+)', 1) || '/' AS site_url, count(*) AS links
    FROM fx_links GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)

# --- row-wise labels ---------------------------------------------------------------------


def _classes(rules: str) -> str:
    return _sql(
        "fx_links",
        body=f"SELECT *, rule <> 'editorial' AS is_mechanical FROM (SELECT {LINK_COLUMNS}, {rules} AS rule FROM fx_links)",
    )


ORACLE["classify_links"] = _classes(_rules(SHIPPED))
ORACLE["classify_links_default_patterns"] = _classes(_rules(BUILT_IN))
ORACLE["classify_links_simple"] = _classes(SIMPLE_RULES)

_A = "trim(anchor)"
_W = _words("trim(anchor)")
_LONG = f"list_filter({_words('lower(anchor)')}, lambda x: length(x) > 3)"
FLAGS = {
    "too_short": f"len({_W}) = 1 AND length({_A}) < 4",
    "too_long": f"len({_W}) > 8",
    "good": f"len({_W}) BETWEEN 2 AND 6",
    "keyword_stuffed": f"coalesce(list_max(map_values(list_histogram({_LONG}))) > 2, false)",
    "url_anchor": f"regexp_matches({_A}, '^(https?://|www\\.)')",
}
FLAGGED = "fl AS (SELECT source, destination, anchor, {} FROM ed)".format(
    ", ".join(f"{e} AS {n}" for n, e in FLAGS.items())
)
ORACLE["anchor_quality"] = _links(f"SELECT destination, anchor, {', '.join(FLAGS)} FROM fl", ctes=FLAGGED)

ORACLE["destination_category"] = _sql(
    "fx_urls", body=f"SELECT url, {_case('lower(url)', DESTINATION_CATEGORIES, chr(39) + 'other' + chr(39))} AS category FROM fx_urls"
)
PAGE_TYPE = _case(
    "lower(url)",
    PAGE_TYPES,
    "CASE WHEN len(url) - len(replace(url, '/', '')) <= 3 AND NOT ends_with(url, '.html') THEN 'section' ELSE 'specific' END",
)
ORACLE["page_type"] = _sql("fx_urls", body=f"SELECT url, {PAGE_TYPE} AS page_type FROM fx_urls")
CONVERSION = _case("concat(lower(url), ' ', lower(title))", CONVERSION_CATEGORIES, "NULL")
ORACLE["conversion_pages"] = _sql(
    "fx_internal_pages",
    body=f"SELECT * FROM (SELECT url, title, {CONVERSION} AS category FROM fx_internal_pages) WHERE category IS NOT NULL",
)
COUNTS = """wc AS (SELECT url, n AS word_count, CASE WHEN n < 300 THEN 'thin' WHEN n <= 1500 THEN 'quality' ELSE 'rich' END AS band
  FROM (SELECT url, TRY_CAST(word_count AS INTEGER) AS n FROM fx_word_counts) WHERE n >= 0)"""
ORACLE["word_count_band"] = _sql("fx_word_counts", ctes=COUNTS, body="SELECT * FROM wc")
PAIRS = """sp AS (SELECT source, target, TRY_CAST(similarity AS DOUBLE) AS similarity FROM fx_similar_pairs WHERE target <> ''),
hi AS (SELECT * FROM sp WHERE similarity >= 0.85)"""
ORACLE["similarity_band"] = _sql(
    "fx_similar_pairs",
    ctes=PAIRS,
    body="""SELECT CASE WHEN similarity > 0.8 THEN 'high' WHEN similarity > 0.6 THEN 'medium' ELSE 'low' END AS band,
    count(*) AS pairs FROM sp WHERE similarity IS NOT NULL GROUP BY 1""",
)

# --- aggregations ----------------------------------------------------------------------------


def _funnel(rules: str) -> str:
    return _sql(
        "fx_links",
        ctes=f"c AS (SELECT {VALID} AS v, {INTERNAL} AS i, {rules} AS rule FROM fx_links)",
        body="""SELECT *, editorial_links / internal_links * 100.0 AS editorial_ratio FROM (
        SELECT count(*) AS total_links, count(*) FILTER (v AND i) AS internal_links,
          count(*) FILTER (v AND NOT i) AS external_links, count(*) FILTER (v AND i AND rule <> 'editorial') AS mechanical_links,
          count(*) FILTER (v AND i AND rule = 'editorial') AS editorial_links, count(*) FILTER (NOT v) AS errors FROM c)""",
    )


ORACLE["link_funnel"] = _funnel(_rules(SHIPPED))
ORACLE["link_funnel_simple"] = _funnel(SIMPLE_RULES)
STATS = """st AS (SELECT *, editorial_links / total_pages AS avg_editorial_per_page,
  editorial_links / total_internal_links * 100.0 AS editorial_ratio FROM (
  SELECT count(DISTINCT source) AS total_pages, count(*) AS total_internal_links,
    count(*) FILTER (NOT mech) AS editorial_links, count(*) FILTER (mech) AS mechanical_links FROM il))"""
ORACLE["link_stats"] = _links("SELECT * FROM st", ctes=STATS)
ORACLE["rule_breakdown"] = _links("SELECT rule, count(*) AS links FROM il WHERE mech GROUP BY rule")
ORACLE["rule_breakdown_all_rules"] = _sql(
    "fx_links",
    body=f"""SELECT rule, count(*) AS links FROM (SELECT CASE
    WHEN regexp_matches(lower(origin), 'navigation|en-tête|pied de page|header|footer|nav|menu') THEN 'origin'
    WHEN l_linenumber = 6 THEN 'link_type'
    WHEN regexp_matches(trim(lower(anchor)), '{SHIPPED}') OR starts_with(lower(anchor), 'promo promo promo ') THEN 'anchor_pattern'
    WHEN l_linenumber <> 5 AND regexp_matches(lower(path), '{PATH_WORDS}') THEN 'path'
    WHEN l_linenumber = 5 THEN 'selector'
    WHEN length(trim(anchor)) <= 2 AND trim(lower(anchor)) NOT IN ('tv', 'pc') THEN 'short_anchor'
    WHEN regexp_matches(trim(lower(anchor)), '^(https?://|www\\.)') THEN 'url_anchor'
    ELSE 'editorial' END AS rule FROM fx_links WHERE {VALID} AND {INTERNAL}) WHERE rule <> 'editorial' GROUP BY rule""",
)
ORACLE["outlink_counts"] = _links("SELECT source, count(*) AS links FROM ed GROUP BY source")
ORACLE["inlink_counts"] = _links("SELECT destination, count(*) AS links FROM ed GROUP BY destination")
ANCHORS = "an AS (SELECT trim(anchor) AS anchor, count(*) AS links FROM ed WHERE trim(anchor) <> '' GROUP BY 1)"
ORACLE["anchor_counts"] = _links("SELECT * FROM an", ctes=ANCHORS)
ORACLE["over_repeated_anchors"] = _links("SELECT * FROM an WHERE links > 5", ctes=ANCHORS)
QUALITY = "q AS (SELECT {} FROM fl)".format(", ".join(f"count(*) FILTER ({n}) AS {n}" for n in FLAGS))
ORACLE["anchor_quality_counts"] = _links("SELECT * FROM q", ctes=f"{FLAGGED}, {QUALITY}")
ORACLE["editorial_score"] = _links(
    """SELECT * EXCLUDE (base, raw), round(raw, 6) AS score,
      CASE WHEN raw >= 80 THEN 'excellent' WHEN raw >= 60 THEN 'medium' ELSE 'poor' END AS rating FROM (
    SELECT *, greatest(0, least(100, base - base / 100.0 * (15 * too_short / editorial_links + 10 * too_long / editorial_links
      + 20 * keyword_stuffed / editorial_links + 25 * url_anchor / editorial_links)
      + least(5, 10 * good / editorial_links) - CASE WHEN editorial_links < 50 THEN 10 ELSE 0 END)) AS raw
    FROM (SELECT *, CASE WHEN editorial_ratio >= 70 THEN 90 WHEN editorial_ratio >= 50 THEN 70 WHEN editorial_ratio >= 30 THEN 50
      WHEN editorial_ratio >= 15 THEN 30 ELSE 10 END AS base
      FROM (SELECT total_internal_links, editorial_links, editorial_ratio, q.* FROM st, q)))""",
    ctes=f"{STATS}, {FLAGGED}, {QUALITY}",
)
ORACLE["destination_category_counts"] = _links(
    f"""SELECT category, links, links / (SELECT count(*) FROM ed) * 100.0 AS share_percent FROM (
    SELECT {_case('lower(destination)', DESTINATION_CATEGORIES, chr(39) + 'other' + chr(39))} AS category, count(*) AS links
    FROM ed GROUP BY 1)"""
)
KEYWORDS = f"""
kw AS (SELECT links, list_filter({_words("regexp_replace(lower(anchor), '[^\\p{L}\\p{N}_\\s]', ' ', 'g')")},
  lambda x: length(x) >= 3 AND NOT list_contains([{_quoted(STOP_WORDS)}], x)) AS w FROM an WHERE length(anchor) > 2),
grams AS (
  SELECT 'word' AS kind, unnest(list_filter(w, lambda x: length(x) >= 4)) AS keyword, links FROM kw
  UNION ALL SELECT 'phrase', unnest(list_filter(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), lambda x: length(x) >= 8)), links FROM kw
  UNION ALL SELECT 'long_phrase', unnest(list_filter(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), lambda x: length(x) >= 12)), links FROM kw),
kc AS (SELECT kind, keyword, uses, round(CASE kind WHEN 'word' THEN uses * (1 + length(keyword) / 10.0) WHEN 'phrase' THEN uses * 2.5
    ELSE uses * 4.0 END, 6)::DOUBLE AS score
  FROM (SELECT kind, keyword, sum(links)::BIGINT AS uses FROM grams GROUP BY 1, 2) WHERE uses >= 2)"""
ORACLE["keyword_counts"] = _links("SELECT * FROM kc", ctes=f"{ANCHORS}, {KEYWORDS}")
ORACLE["anchor_keywords"] = _links("SELECT * FROM kc ORDER BY score DESC, keyword LIMIT 15", ctes=f"{ANCHORS}, {KEYWORDS}")
ORACLE["word_count_stats"] = _sql(
    "fx_word_counts",
    ctes=COUNTS,
    body="""SELECT count(*) AS total_pages, sum(word_count) / count(*) AS avg_words,
    list_sort(list(word_count))[count(*) // 2 + 1] AS median_words, min(word_count) AS min_words, max(word_count) AS max_words,
    count(*) FILTER (band = 'thin') AS thin_pages, count(*) FILTER (band = 'quality') AS quality_pages,
    count(*) FILTER (band = 'rich') AS rich_pages FROM wc""",
)
_TW, _HW = _words("lower(title)"), _words("lower(h1)")
JACCARD = f"""CASE WHEN len({_TW}) = 0 OR len({_HW}) = 0 THEN 0.0
  ELSE len(list_intersect({_TW}, {_HW})) / len(list_distinct(list_concat({_TW}, {_HW}))) END"""
COHERENCE = f"""co AS (SELECT url, title, h1, CASE WHEN title = '' THEN 'missing_title' WHEN h1 = '' THEN 'missing_h1'
  WHEN lower(trim(title)) = lower(trim(h1)) THEN 'identical' WHEN {JACCARD} > 0.7 THEN 'similar' ELSE 'different' END AS status
  FROM fx_page_attrs WHERE title <> '' OR h1 <> '')"""
ORACLE["title_h1_coherence"] = _sql("fx_page_attrs", ctes=COHERENCE, body="SELECT * FROM co")
ORACLE["title_h1_summary"] = _sql(
    "fx_page_attrs",
    ctes=COHERENCE,
    body="SELECT count(*) FILTER (title <> '' AND h1 <> '') AS pages_with_both, "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("identical", "similar", "different", "missing_h1", "missing_title"))
    + " FROM co",
)
ORACLE["conversion_summary"] = _sql(
    "fx_internal_pages",
    ctes=f"c AS (SELECT {CONVERSION} AS category FROM fx_internal_pages)",
    body="""SELECT category, count(*) AS pages, (SELECT count(category) FROM c) AS conversion_pages,
    (SELECT count(category) / count(*) * 100.0 FROM c) AS share_percent FROM c WHERE category IS NOT NULL GROUP BY category""",
)
ORACLE["high_similarity_pairs"] = _sql("fx_similar_pairs", ctes=PAIRS, body="SELECT * FROM hi")
ORACLE["similar_pairs_summary"] = _sql(
    "fx_similar_pairs",
    ctes=PAIRS,
    body="SELECT count(*) AS pairs, round(avg(similarity), 6) AS avg_similarity, max(similarity) AS max_similarity FROM hi",
)
ORACLE["top_similar_pairs"] = _sql(
    "fx_similar_pairs", ctes=PAIRS, body="SELECT * FROM hi ORDER BY similarity DESC, source, target LIMIT 50"
)
ORACLE["top_similarity_scores"] = _sql(
    "fx_similar_pairs", ctes=PAIRS, body="SELECT similarity FROM hi ORDER BY similarity DESC LIMIT 10"
)
SIZES = "cs AS (SELECT coalesce(cluster_id, 'unclustered') AS cluster_id, count(*) AS pages FROM fx_clusters GROUP BY 1)"
ORACLE["cluster_summary"] = _sql(
    "fx_clusters",
    ctes=SIZES,
    body="""SELECT count(*) AS total_clusters, count(*) FILTER (pages >= 3) AS meaningful_clusters,
    sum(pages)::BIGINT AS clustered_pages, sum(pages)::BIGINT / count(*) AS avg_cluster_size FROM cs""",
)
ORACLE["largest_clusters"] = _sql(
    "fx_clusters", ctes=SIZES, body="SELECT * FROM cs WHERE pages >= 3 ORDER BY pages DESC, cluster_id LIMIT 10"
)
ORACLE["domain_counts"] = _links(
    f"SELECT {_host('destination')} AS host, count(*) AS links FROM cl WHERE rule = 'editorial' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"
)
ORACLE["editorial_yield"] = _links(
    f"""SELECT *, editorial_links / crawled_links * 100.0 AS yield_percent FROM (
    SELECT count(*) FILTER (rule = 'editorial') AS editorial_links,
      count(*) FILTER (rule = 'editorial' AND starts_with(destination, '{SITE}')) AS internal_editorial_links,
      count(*) AS crawled_links FROM cl)"""
)
ORACLE["anchor_diversity"] = _sql(
    "fx_theme_anchors",
    body="""SELECT *, distinct_anchors / anchors AS diversity FROM (
    SELECT sum(links)::BIGINT AS anchors, count(DISTINCT lower(trim(anchor))) AS distinct_anchors
    FROM fx_theme_anchors WHERE length(trim(anchor)) > 3)""",
)

# --- joins and sets ------------------------------------------------------------------------------

ORACLE["orphan_pages"] = _links("SELECT source AS url FROM il EXCEPT SELECT destination FROM ed")
ORACLE["orphan_pages_of_list"] = _links(
    f"""(SELECT source AS url FROM il UNION SELECT url FROM fx_urls WHERE starts_with(url, '{SITE}'))
    EXCEPT SELECT destination FROM ed WHERE source <> destination""",
    "fx_urls",
)
ORACLE["page_profile"] = _links(
    """SELECT url, bool_or(s) AS is_source, sum(s::INT)::BIGINT AS internal_out, sum(o)::BIGINT AS outlinks, sum(i)::BIGINT AS inlinks, sum(ob)::BIGINT AS outbound,
    sum(ib)::BIGINT AS inbound FROM (
    SELECT source AS url, true AS s, (NOT mech)::INT AS o, 0 AS i, (NOT mech AND source <> destination)::INT AS ob, 0 AS ib FROM il
    UNION ALL SELECT destination, false, 0, (NOT mech)::INT, 0, (NOT mech AND source <> destination)::INT FROM il) GROUP BY url"""
)
ORACLE["linked_similar_filter"] = _links(
    """SELECT * FROM (SELECT replace(source, '/guide/', '/blog/') AS source, replace(target, '/guide/', '/produits/') AS target,
      similarity FROM hi) p
    WHERE NOT EXISTS (SELECT 1 FROM il WHERE il.source = p.source AND il.destination = p.target)
      AND NOT EXISTS (SELECT 1 FROM il WHERE il.source = p.target AND il.destination = p.source)""",
    "fx_similar_pairs",
    ctes=PAIRS,
)
# Which links stand in the content of a page follows from the line number, without any HTML.
CONTENT_LINKS = """
pl AS (SELECT source AS page_url, CASE WHEN destination = '' THEN source ELSE destination END AS href,
  trim(concat(anchor, CASE WHEN l_linenumber = 5 THEN ' en stock' ELSE '' END)) AS text FROM fx_links WHERE l_linenumber > 2),
pc AS (SELECT * FROM pl WHERE length(text) > 2)"""
ORACLE["content_links_of_link_pages"] = _sql("fx_links", ctes=CONTENT_LINKS, body="SELECT * FROM pc")
ORACLE["match_editorial_links"] = _sql(
    "fx_links",
    ctes=CONTENT_LINKS,
    body=f"""SELECT source, destination, anchor FROM fx_links l
    WHERE (starts_with(destination, 'https://{HOST}') OR starts_with(destination, 'http://{HOST}')) AND EXISTS (
      SELECT 1 FROM pc WHERE pc.page_url = l.source AND rtrim(pc.href, '/') = rtrim(l.destination, '/')
        AND (trim(l.anchor) = pc.text OR (length(trim(l.anchor)) > 3 AND contains(lower(pc.text), lower(trim(l.anchor))))))""",
)


def _overrides(page_rule: str) -> str:
    return f"""
lb AS (SELECT *, regexp_extract(page_url, '^([^?]*)', 1) AS base, trim(lower(text)) AS lt,
  string_split(trim(lower(href)), '/')[-1] AS seg FROM fx_labels),
bases AS (SELECT DISTINCT page_url, base FROM lb),
pg AS (SELECT source, arg_min(page_url, {{'n': -length(base), 'u': page_url}}) AS page_url
  FROM (SELECT DISTINCT source FROM fx_links) s JOIN bases ON {page_rule} GROUP BY source),
wanted AS (SELECT DISTINCT source, trim(lower(anchor)) AS t, trim(lower(destination)) AS u FROM fx_links),
best AS (SELECT w.source, w.t, w.u,
    min({{'a': lb.href, 'b': lb.text, 'c': lb.category, 'd': lb.confidence}}) AS label
  FROM wanted w JOIN pg ON pg.source = w.source JOIN lb ON lb.page_url = pg.page_url
  WHERE w.t = lb.lt OR ((contains(lb.lt, w.t) OR contains(w.t, lb.lt)) AND ends_with(w.u, lb.seg)) GROUP BY ALL),
fixed AS (SELECT c.source, c.destination, c.anchor, c.origin, c.path, c.link_type, c.rule, c.rule <> 'editorial' AS mech,
    b.label, coalesce((b.label.c IN ('EDITORIAL', 'CALL_TO_ACTION')) = (c.rule <> 'editorial'), false) AS corrected
  FROM cl c LEFT JOIN best b ON b.source = c.source AND b.t = trim(lower(c.anchor)) AND b.u = trim(lower(c.destination)))"""


OVERRIDDEN = """SELECT source, destination, anchor, origin, path, link_type, rule, mech <> corrected AS is_mechanical,
  corrected AS label_corrected, CASE WHEN corrected THEN label.c END AS label_category,
  CASE WHEN corrected THEN label.d END AS label_confidence FROM fixed"""
_PREFIX = "starts_with(s.source, bases.base)"
ORACLE["apply_label_overrides"] = _links(OVERRIDDEN, "fx_labels", ctes=_overrides(_PREFIX))
ORACLE["apply_label_overrides_same_page"] = _links(
    OVERRIDDEN, "fx_labels", ctes=_overrides("regexp_extract(s.source, '^([^?]*)', 1) = bases.base")
)
ORACLE["correction_counts"] = _links(
    "SELECT label.c AS label_category, count(*) AS corrections FROM fixed WHERE corrected GROUP BY 1",
    "fx_labels",
    ctes=_overrides(_PREFIX),
)


def _nodes(n: int) -> str:
    return f"""
nx AS (SELECT * FROM ed WHERE source <> destination),
nd AS (SELECT id, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound FROM (
  SELECT destination AS id, 1 AS i, 0 AS o FROM nx UNION ALL SELECT source, 0, 1 FROM nx) GROUP BY id
  ORDER BY sum(i) + sum(o) DESC, id LIMIT {n}),
ne AS (SELECT source, destination AS target, CASE WHEN length(trim(anchor)) > 50 THEN trim(anchor)[:50] || '...' ELSE trim(anchor) END AS anchor
  FROM nx WHERE source IN (SELECT id FROM nd) AND destination IN (SELECT id FROM nd))"""


def _label(expr: str) -> str:
    p = f"rtrim({_path(expr)}, '/')"
    return f"CASE WHEN {p} = '' THEN '/' WHEN length({p}) > 30 THEN {p}[:27] || '...' ELSE {p} END"


ORACLE["network_nodes"] = _links(f"SELECT *, {_label('id')} AS label FROM nd", ctes=_nodes(100))
ORACLE["network_edges"] = _links("SELECT * FROM ne", ctes=_nodes(100))
ORACLE["network_edge_list"] = _links("SELECT * FROM ne ORDER BY source, target, anchor LIMIT 500", ctes=_nodes(1000))
ORPHANS = "orp AS (SELECT source AS url FROM il EXCEPT SELECT destination FROM ed)"
RECOMMENDATIONS = f"""
rec(kind, priority, url, problem, recommendation, details) AS (
  SELECT 'orphan page', 'high', url, 'no editorial link leads here', 'create contextual editorial links',
    'page outside the editorial linking' FROM orp
  UNION ALL SELECT 'weak anchor', 'medium', destination, 'anchor too short: ''' || trim(anchor) || '''',
    'use a more descriptive anchor', 'current anchor: ''' || trim(anchor) || '''' FROM fl WHERE too_short
  UNION ALL SELECT 'stuffed anchor', 'high', destination, 'anchor repeats its keywords: ''' || trim(anchor) || '''',
    'vary with natural phrases', 'risk of a search penalty' FROM fl WHERE keyword_stuffed
  UNION ALL SELECT 'unoptimised anchor', 'medium', destination, 'URL used as anchor: ''' || trim(anchor) || '''',
    'replace by a descriptive anchor', 'URLs make poor anchors' FROM fl WHERE url_anchor
  UNION ALL SELECT 'repeated anchor', 'medium', 'multiple', 'anchor used ' || links || ' times: ''' || anchor || '''',
    'vary the wording', 'excessive repetition (' || links || ' uses)' FROM an WHERE links > 5
  UNION ALL SELECT 'overall strategy', 'high', '{SITE}', 'low editorial share (' || printf('%.1f', editorial_ratio) || '%)',
    'add editorial links to the contents', 'less than 50% editorial links' FROM st WHERE editorial_ratio < 50
  UNION ALL SELECT 'link density', 'medium', '{SITE}', 'too few links (' || printf('%.1f', avg_editorial_per_page) || ' links/page)',
    'aim at 2-3 editorial links per page', 'internal linking below optimum' FROM st WHERE avg_editorial_per_page < 2)"""
_REC = f"{STATS}, {FLAGGED}, {ANCHORS}, {ORPHANS}, {RECOMMENDATIONS}"
ORACLE["recommendations"] = _links("SELECT * FROM rec", ctes=_REC)
ORACLE["write_recommendations"] = ORACLE["recommendations"]
ORACLE["write_editorial_links"] = _links("SELECT source, destination, anchor FROM ed")
ORACLE["priority_advice"] = _links(
    """SELECT 1 AS position, 'link orphan pages' AS advice, count(*)::DOUBLE AS figure FROM orp HAVING count(*) > 0
    UNION ALL SELECT 2, 'raise the editorial share', editorial_ratio FROM st WHERE editorial_ratio < 90
    UNION ALL SELECT 3, 'describe short anchors', too_short::DOUBLE FROM q WHERE too_short > 0
    UNION ALL SELECT 4, 'add editorial links', avg_editorial_per_page FROM st WHERE avg_editorial_per_page < 10""",
    ctes=f"{STATS}, {FLAGGED}, {QUALITY}, {ORPHANS}",
)
ORACLE["missing_link_recommendations"] = _sql(
    "fx_similar_pairs",
    ctes=PAIRS,
    body="""SELECT source AS source_page, target AS target_page, similarity AS similarity_score,
    'editorial link recommended (similarity: ' || printf('%.3f', similarity) || ')' AS recommendation,
    CASE WHEN similarity > 0.9 THEN 'high' ELSE 'medium' END AS priority FROM hi ORDER BY similarity DESC, source, target LIMIT 20""",
)
ORACLE["pillar_page_recommendations"] = _sql(
    "fx_clusters",
    ctes=SIZES,
    body="""SELECT cluster_id AS cluster, pages AS pages_count,
    'create a pillar page for cluster ''' || cluster_id || ''' (' || pages || ' pages)' AS recommendation,
    CASE WHEN pages > 10 THEN 'high' ELSE 'medium' END AS priority FROM cs WHERE pages >= 5""",
)

# --- top lists and samples --------------------------------------------------------------------

ORACLE["top_linking_pages"] = _links("SELECT source, count(*) AS links FROM ed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
ORACLE["most_linked_pages"] = _links("SELECT destination, count(*) AS links FROM ed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
ORACLE["top_anchors"] = _links("SELECT * FROM an ORDER BY links DESC, anchor LIMIT 20", ctes=ANCHORS)
_KINDS = ("specific_or_article", "product", "contact", "section", "other")


def _sample(samples: int, where: str) -> str:
    """Quotas as a recursion over the five kinds, then ranks within each kind."""
    kinds = ", ".join(f"({i}, '{k}')" for i, k in enumerate(_KINDS))
    return f"""
cu AS (SELECT DISTINCT url FROM fx_urls WHERE contains(url, '{HOST}') AND NOT {_contains('lower(url)', SKIPPED_URL_PARTS['deep'])} AND {where}),
ty AS (SELECT url, CASE WHEN t IN ('article', 'specific') THEN 'specific_or_article' ELSE t END AS kind FROM (SELECT url, {PAGE_TYPE} AS t FROM cu)),
k AS (SELECT i, kind, (SELECT count(*) FROM ty WHERE ty.kind = v.kind) AS have FROM (VALUES {kinds}) v(i, kind)),
quota AS (SELECT -1 AS i, '' AS kind, 0::BIGINT AS take, {samples}::BIGINT AS remaining
  UNION ALL SELECT i, kind, take, remaining - take FROM (
    SELECT k.i, k.kind, q.remaining, CASE WHEN k.have > 0 AND q.remaining > 0
      THEN least(k.have, greatest(1, q.remaining // (5 - k.i))) ELSE 0 END AS take FROM quota q JOIN k ON k.i = q.i + 1)),
rk AS (SELECT url, kind, row_number() OVER (PARTITION BY kind ORDER BY url) AS rn FROM ty)"""


def _sampled(limit: int) -> str:
    return f"""SELECT min(ord)::INTEGER AS ord, url, {PAGE_TYPE} AS page_type FROM (
    SELECT 0 AS ord, '{SITE}' AS url UNION ALL
    SELECT (quota.i + 1) * {limit} + rn, url FROM rk JOIN quota ON quota.kind = rk.kind AND rk.rn <= quota.take)
    GROUP BY url ORDER BY min(ord), url LIMIT {limit}"""


ORACLE["sample_pages"] = _sql("fx_urls", ctes=_sample(7, "true"), body=_sampled(8))
ORACLE["sample_pages_of_section"] = _sql("fx_urls", ctes=_sample(4, "contains(url, '/expertise/')"), body=_sampled(5))
ORACLE["dedupe_urls"] = _sql(
    "fx_links",
    body="SELECT destination AS url, min(l_orderkey) AS ord FROM fx_links GROUP BY 1 ORDER BY 2, 1 LIMIT 50",
)

# --- HTML ----------------------------------------------------------------------------------------

# All links of the delivered pages stand in the one flat <nav> and are rooted.
FLAT = """
x AS (SELECT url, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages),
y AS (SELECT url, unnest(regexp_extract_all(nav, '<a\\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href,
  unnest(regexp_extract_all(nav, '<a\\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS text,
  generate_subscripts(regexp_extract_all(nav, '<a\\s[^>]*href="([^"]*)"[^>]*>', 1), 1)::INTEGER - 1 AS position FROM x)"""
_ABSOLUTE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS href"
ORACLE["extract_page_links"] = _sql(
    ctes=FLAT, body=f"SELECT url AS page_url, position, {_ABSOLUTE}, trim(text) AS text, false AS in_zone, true AS in_nav FROM y"
)
ORACLE["extract_page_links_own_parser"] = _sql(
    ctes=FLAT, body=f"SELECT url AS page_url, position, {_ABSOLUTE}, trim(text) AS text, '' AS context, true AS in_zone, false AS in_nav FROM y"
)
ORACLE["extract_flat_links"] = _sql(
    ctes=FLAT, body=f"SELECT url AS page_url, position, {_ABSOLUTE}, trim(text) AS text FROM y"
)
_NESTED = "'https://www.shop.example/n/' || page_id AS page_url"
_ROOT = "https://www.shop.example"
ORACLE["nav_zone"] = f"""
SELECT {_NESTED}, position, href, text, text AS context FROM pages, (VALUES
  (0, '{_ROOT}/home', 'Accueil'), (2, '{_ROOT}/b', 'voisin'), (3, '{_ROOT}/c', 'rayon')) v(position, href, text)
UNION ALL SELECT {_NESTED}, 5, '{_ROOT}/e', 'proche menu', 'proche menuloin du menu' FROM pages"""
ORACLE["content_zone_links"] = f"""
SELECT {_NESTED}, 1 AS position, '{_ROOT}/a' || page_id AS href, 'guide bois ' || page_id AS text,
  'xguide bois ' || page_id AS context FROM pages
UNION ALL SELECT {_NESTED}, 6, '{_ROOT}/f' || page_id, 'loin du menu', 'loin du menu' FROM pages"""
_VISIBLE = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'),
  '<style[^>]*>.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g')"""
ORACLE["page_attributes"] = f"""
SELECT url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1,
  len({_words(_VISIBLE)})::INTEGER AS word_count FROM pages"""
ORACLE["clean_html"] = """
SELECT url, CASE WHEN body = '' THEN visible ELSE body END AS html FROM (
  SELECT url, visible, regexp_extract(visible, '(<body.*</body>)', 1, 's') AS body FROM (
    SELECT url, regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs') AS visible
    FROM pages))"""

# --- expressions ---------------------------------------------------------------------------------

ORACLE["url_functions"] = _sql(
    "fx_urls",
    body=f"""SELECT url, {_host('url')} AS host, {_path('url')} AS path, {_label('url')} AS label,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/a/b' AS joined_root,
    CASE WHEN length(url) > 20 THEN url[:20] || '...' ELSE url END AS short FROM fx_urls""",
)
ORACLE["text_functions"] = _sql(
    "fx_page_attrs",
    ctes=f"w AS (SELECT url, title, h1, {_TW} AS w FROM fx_page_attrs)",
    body=f"""SELECT url, len(w)::INTEGER AS n_words,
    array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS pairs,
    array_to_string(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), '|') AS triples,
    round({JACCARD}, 6) AS jaccard FROM w""",
)

# --- vectors and themes --------------------------------------------------------------------------


def _vector(expr: str) -> str:
    """Word counts in 64 buckets by the first eight hex digits of MD5."""
    buckets = f"list_transform({_words(f'lower({expr})')}, lambda w: ('0x' || md5(w)[1:8])::BIGINT % 64)"
    return f"list_transform(range(64), lambda i: len(list_filter({buckets}, lambda b: b = i))::DOUBLE)"


ORACLE["embed_texts"] = _sql(
    "fx_texts",
    ctes=f"t AS (SELECT DISTINCT text FROM fx_texts WHERE length(trim(text)) >= 3), v AS (SELECT md5(text) AS m, {_vector('text')} AS e FROM t)",
    body="SELECT m AS text_md5, array_to_string(list_transform(e, lambda x: x::INT::VARCHAR), ',') AS vector, m[1] < '8' AS cached FROM v",
)
ORACLE["embed_texts_cached"] = ORACLE["embed_texts"]
ORACLE["embedding_cache_stats"] = "SELECT count(*) AS entries, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings"
ORACLE["similar_page_pairs"] = _sql(
    "fx_page_vectors",
    body="""SELECT source, target, round(s, 6) AS similarity FROM (
    SELECT least(a.id, b.id) AS source, greatest(a.id, b.id) AS target, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS s
    FROM fx_page_vectors a JOIN fx_page_vectors b ON a.id < b.id) WHERE s > 0.6 ORDER BY s DESC, source, target LIMIT 20""",
)
FIT = f"""
uses AS (SELECT trim(anchor) AS anchor, destination, count(*) AS links FROM ed WHERE trim(anchor) <> '' GROUP BY 1, 2),
pv AS (SELECT url, {_vector('content')} AS e FROM contents),
av AS (SELECT anchor, CASE WHEN length(anchor) < 3 THEN list_transform(range(64), lambda i: 0.0::DOUBLE) ELSE {_vector('anchor')} END AS e
  FROM (SELECT DISTINCT anchor FROM uses)),
ac AS (SELECT u.anchor, u.destination, u.links, coalesce(CASE WHEN list_sum(av.e) = 0 THEN 0.0
    ELSE list_cosine_similarity(av.e, pv.e) END, 0.0) AS similarity
  FROM uses u JOIN pv ON pv.url = u.destination JOIN av ON av.anchor = u.anchor)"""
ORACLE["anchor_coherence"] = _links(
    "SELECT anchor, destination, links, round(similarity, 6) AS similarity FROM ac",
    "fx_part_attrs",
    ctes=f"{WIDE}, {CONTENT}, {FIT}",
)
_COHERENCE = """SELECT round(sum(similarity * links) / sum(links), 6) AS average_score, coalesce(sum(links), 0)::BIGINT AS total_analyzed,
    coalesce(sum(links) FILTER (similarity > 0.7), 0)::BIGINT AS high_coherence,
    coalesce(sum(links) FILTER (similarity < 0.4), 0)::BIGINT AS low_coherence FROM ac"""
ORACLE["coherence_summary"] = _links(_COHERENCE, "fx_part_attrs", ctes=f"{WIDE}, {CONTENT}, {FIT}")


def _dbscan(points: str, min_samples: int, cosine: float = 0.8, tag: str = "") -> str:
    """DBSCAN over ``points(id, e, weight)`` with a radius of 1 less the cosine: components by recursion. The result is ``db`` and the tag."""
    near, core, ce, reach, lab = (f"{name}{tag}" for name in ("near", "core", "ce", "reach", "lab"))
    return f"""
{near} AS MATERIALIZED (SELECT a.id AS a, b.id AS b, b.weight AS weight FROM {points} a JOIN {points} b
  ON a.id = b.id OR round(list_cosine_similarity(a.e, b.e), 9) >= {cosine}),
{core} AS MATERIALIZED (SELECT a AS id FROM {near} GROUP BY a HAVING sum(weight) >= {min_samples}),
{ce} AS MATERIALIZED (SELECT a, b FROM {near} WHERE a IN (SELECT id FROM {core}) AND b IN (SELECT id FROM {core})),
{reach} AS (SELECT id, id AS seen FROM {core} UNION SELECT {reach}.id, {ce}.b FROM {reach} JOIN {ce} ON {ce}.a = {reach}.seen),
{lab} AS MATERIALIZED (SELECT id, min(seen) AS label FROM {reach} GROUP BY id),
db{tag} AS MATERIALIZED (SELECT p.id, p.weight, p.id IN (SELECT id FROM {core}) AS is_core, coalesce({lab}.label, bd.label) AS label FROM {points} p
  LEFT JOIN {lab} ON {lab}.id = p.id
  LEFT JOIN (SELECT {near}.a, min({lab}.label) AS label FROM {near} JOIN {lab} ON {lab}.id = {near}.b GROUP BY {near}.a) bd ON bd.a = p.id)"""


ORACLE["density_clusters"] = _sql(
    "fx_page_vectors",
    ctes="pt AS MATERIALIZED (SELECT id, embedding AS e, 1 AS weight FROM fx_page_vectors)," + _dbscan("pt", 3),
    body="SELECT id, is_core, label FROM db",
)


def _themes(anchors: str, enough: str = "true") -> str:
    """Themes of at least two links; a single cluster with more than half of the points besides noise is searched with the smaller radius."""
    return f"""
pt AS MATERIALIZED (SELECT anchor AS id, {_vector('anchor')} AS e, links AS weight FROM {anchors} WHERE length(trim(anchor)) > 3),
{_dbscan('pt', 2)},
{_dbscan('pt', 2, 0.85, '_close')},
again AS MATERIALIZED (SELECT count(DISTINCT label) = 1 AND bool_or(label IS NULL) AND 2 * sum(weight) FILTER (label IS NOT NULL) > sum(weight) AS dominant FROM db),
grouped AS (SELECT db.* FROM db, again WHERE NOT dominant UNION ALL SELECT db_close.* FROM db_close, again WHERE dominant),
th AS (SELECT id AS anchor, weight AS links, label AS theme FROM grouped
  WHERE {enough} AND label IN (SELECT label FROM grouped GROUP BY label HAVING sum(weight) >= 2))"""


THEMES = _themes("fx_theme_anchors")
ORACLE["cluster_themes"] = _sql("fx_theme_anchors", ctes=THEMES, body="SELECT * FROM th")
ORACLE["cluster_themes_dominant"] = _sql("fx_dominant_anchors", ctes=_themes("fx_dominant_anchors"), body="SELECT * FROM th")


def _uses(stops: tuple[str, ...]) -> str:
    stop = f" AND NOT list_contains([{_quoted(stops)}], x)" if stops else ""
    return f"""wu AS (SELECT theme, word, sum(links)::BIGINT AS uses FROM (
  SELECT theme, unnest(list_filter({_words('lower(anchor)')}, lambda x: length(x) > 3{stop})) AS word, links FROM th) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY uses DESC, word) AS n FROM wu)"""


def _title(word: str) -> str:
    return f"upper({word}[1]) || {word}[2:]"


_NAMES = f"""SELECT theme, CASE WHEN w2 IS NOT NULL THEN {_title('w1')} || ' + ' || {_title('w2')}
      WHEN w1 IS NOT NULL THEN {_title('w1')} || ' (' || links || ' links)' ELSE 'Theme ' || theme END AS name, anchors, links
    FROM (SELECT theme, max(word) FILTER (n = 1 AND uses >= 2) AS w1, max(word) FILTER (n = 2 AND uses >= 2) AS w2 FROM rk GROUP BY theme)
    JOIN (SELECT theme, count(*) AS anchors, sum(links)::BIGINT AS links FROM th GROUP BY theme) USING (theme)"""
_MOST_USED = """SELECT theme, n::INTEGER AS position, word, uses, round(0.8 + uses / max(uses) OVER (PARTITION BY theme) * 0.8, 6) AS size
    FROM rk WHERE n <= 10"""
ORACLE["name_themes"] = _sql("fx_theme_anchors", ctes=f"{THEMES}, {_uses(THEME_STOP_WORDS)}", body=_NAMES)
ORACLE["theme_words"] = _sql("fx_theme_anchors", ctes=f"{THEMES}, {_uses(())}", body=_MOST_USED)

# --- the whole audit -------------------------------------------------------------------------

_TABLES = {
    "funnel": "link_funnel",
    "stats": "link_stats",
    "score": "editorial_score",
    "rules": "rule_breakdown",
    "top_linking_pages": "top_linking_pages",
    "most_linked_pages": "most_linked_pages",
    "top_anchors": "top_anchors",
    "over_repeated_anchors": "over_repeated_anchors",
    "orphan_pages": "orphan_pages",
    "destination_categories": "destination_category_counts",
    "anchor_keywords": "anchor_keywords",
    "network_nodes": "network_nodes",
    "recommendations": "recommendations",
    "word_count_stats": "word_count_stats",
    "title_h1_summary": "title_h1_summary",
    "conversion_pages": "conversion_pages",
    "conversion_summary": "conversion_summary",
    "similar_pairs_summary": "similar_pairs_summary",
    "similar_pairs": "top_similar_pairs",
    "similarity_scores": "top_similarity_scores",
    "missing_links": "missing_link_recommendations",
    "cluster_summary": "cluster_summary",
    "largest_clusters": "largest_clusters",
    "pillar_pages": "pillar_page_recommendations",
}
#: Where a table of an audit is not the result of a query as it stands.
_DERIVED = {
    "network_edges": _links("SELECT * FROM ne ORDER BY source, target, anchor LIMIT 500", ctes=_nodes(100)),
    # with the thresholds of the settings, where the query has its own
    "priority_advice": ORACLE["priority_advice"].replace("editorial_ratio < 90", "editorial_ratio < 50").replace(
        "avg_editorial_per_page < 10", "avg_editorial_per_page < 2"),
    "flagged_anchors": f"SELECT * FROM ({ORACLE['anchor_quality']}) WHERE too_short OR keyword_stuffed OR url_anchor",
    "thin_pages": f"SELECT * FROM ({ORACLE['word_count_band']}) WHERE band = 'thin'",
    "title_h1_different": "SELECT url, {}, {} FROM ({}) WHERE status = 'different'".format(
        *(f"CASE WHEN length({c}) > 60 THEN {c}[:60] || '...' ELSE {c} END AS {c}" for c in ("title", "h1")), ORACLE["title_h1_coherence"]
    ),
}


def _title_name(ctes: str, *fixtures: str) -> dict[str, str]:
    """SQL of theme names and words over the themes of ``ctes``."""
    return {
        "theme_names": _sql(*fixtures, ctes=f"{ctes}, {_uses(THEME_STOP_WORDS)}", body=_NAMES),
        "theme_words": _sql(*fixtures, ctes=f"{ctes}, {_uses(())}", body=_MOST_USED),
    }


def _semantic_tables(links: str, attrs: str) -> dict[str, str]:
    """The semantic tables of an audit of ``links`` and page attributes ``attrs``."""
    classes = CLASSES.replace("FROM fx_links", f"FROM {links}")
    wide = WIDE.replace("fx_part_attrs", attrs)
    enough = "(SELECT count(DISTINCT lower(trim(anchor))) >= 0.3 * sum(links) AND sum(links) >= 2 FROM an WHERE length(trim(anchor)) > 3)"
    themes = f"{classes},\nan AS MATERIALIZED (SELECT trim(anchor) AS anchor, count(*) AS links FROM ed WHERE trim(anchor) <> '' GROUP BY 1), {_themes('an', enough)}"
    plain = "plain AS (SELECT url, concat_ws(' ', {}) AS content FROM wide)".format(", ".join(f"nullif({a}, '')" for a in _ATTRS[:6]))
    return {
        **_title_name(themes, links),
        "coherence_summary": _sql(links, attrs, ctes=f"{classes},\n{wide}, {CONTENT}, {FIT}", body=_COHERENCE),
        "link_opportunities": _sql(
            links, attrs,
            ctes=f"{classes},\n{wide}, {plain}, pv AS MATERIALIZED (SELECT url, {_vector('content')} AS e FROM plain WHERE length(trim(content)) >= 3)",
            body="""SELECT least(a.url, b.url) AS source, greatest(a.url, b.url) AS target, round(list_cosine_similarity(a.e, b.e), 9) AS similarity
    FROM pv a JOIN pv b ON a.url < b.url WHERE round(list_cosine_similarity(a.e, b.e), 9) > 0.6
      AND (a.url, b.url) NOT IN (SELECT (source, destination) FROM il) AND (b.url, a.url) NOT IN (SELECT (source, destination) FROM il)
    ORDER BY 3 DESC, 1, 2 LIMIT 20""",
        ),
    }


_EVERY = {**{name: ORACLE[q] for name, q in _TABLES.items()}, **_DERIVED}


def _digests(tables: dict[str, str]) -> str:
    return "\nUNION ALL ".join(digest_sql(name, sql) for name, sql in tables.items())


ORACLE["audit_tables"] = _digests({**_EVERY, **_semantic_tables("fx_links", "fx_part_attrs")})
ORACLE["audit_of_folder"] = ORACLE["audit_tables"]
ORACLE["semantic_tables"] = _digests(_semantic_tables("fx_varied_links", "fx_varied_attrs"))

_SIMPLE = ("funnel", "stats", "top_linking_pages", "most_linked_pages", "top_anchors", "over_repeated_anchors", "orphan_pages")
ORACLE["simple_audit"] = _digests({name: _EVERY[name].replace(_rules(SHIPPED), SIMPLE_RULES) for name in _SIMPLE})

# The guided audit is that of the links which page HTML confirms: they take the place of all links.
_OF_LINKS = ("funnel", "stats", "score", "rules", "top_linking_pages", "most_linked_pages", "top_anchors", "over_repeated_anchors", "orphan_pages",
             "flagged_anchors", "destination_categories", "anchor_keywords", "network_nodes", "network_edges", "recommendations", "priority_advice")
_ALL = f"fx_links AS ({FIXTURES['fx_links'].strip()})"
_CONFIRMED = f"""fx_all AS ({FIXTURES['fx_links'].strip()}),
{CONTENT_LINKS.replace('FROM fx_links', 'FROM fx_all')},
fx_links AS ({ORACLE['match_editorial_links'].split(CONTENT_LINKS.strip())[1].strip().replace('SELECT source, destination, anchor FROM fx_links l', 'SELECT * FROM fx_all l')})"""


def _confirmed(sql: str) -> str:
    return sql.replace(_ALL, _CONFIRMED)


ORACLE["guided_audit"] = _digests({
    **{name: _confirmed(_EVERY[name]) for name in _OF_LINKS},
    "editorial_links": ORACLE["match_editorial_links"],
    "editorial_yield": _confirmed(_sql("fx_links", body=f"""SELECT *, editorial_links / crawled_links * 100.0 AS yield_percent FROM (
        SELECT count(*) AS editorial_links, count(*) FILTER (starts_with(destination, 'https://{HOST}')) AS internal_editorial_links,
          (SELECT count(*) FROM fx_all WHERE {VALID}) AS crawled_links FROM fx_links)""")),
    "domain_counts": _confirmed(_sql("fx_links", body=f"SELECT {_host('destination')} AS host, count(*) AS links FROM fx_links GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")),
})
ORACLE["link_opportunities"] = _sql(
    "fx_page_vectors",
    body="""SELECT source, target, round(s, 6) AS similarity FROM (
    SELECT *, row_number() OVER (ORDER BY s DESC, source, target) AS n FROM (
    SELECT least(a.id, b.id) AS source, greatest(a.id, b.id) AS target, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS s
    FROM fx_page_vectors a JOIN fx_page_vectors b ON a.id < b.id) WHERE s > 0.6) WHERE n <= 40 AND n % 2 = 0""",
)
