"""Input tables of the registered queries, derived from the delivered tables by SQL.

Each fixture covers its whole source tables. A text is valid in Spark and DuckDB unless a pair of
texts is given, first Spark, then DuckDB.
"""

from __future__ import annotations

import uuid

from ..session import checkpoint_dir, shuffles_dropped

SITE = "https://www.shop.example/"
HOST = "www.shop.example"


def _section(key: str) -> str:
    names = ("blog/", "produits/", "contact/", "expertise/", "carriere/", "panier/")
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {key} % 7 {cases} ELSE 'guide/' END"


def _text(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR(20))"


FIXTURES: dict[str, str | tuple[str, str]] = {}

# Link export: every anchor bucket, most class rules, external links, blank anchors, orphans.
FIXTURES["fx_links"] = f"""
SELECT l.l_orderkey, l.l_linenumber,
  concat('{SITE}', {_section('l.l_orderkey')}, 'p', {_text('l.l_orderkey')}) AS source,
  concat(CASE WHEN l.l_tax >= 0.08 THEN 'https://partner.example/' ELSE '{SITE}' END,
         {_section('l.l_partkey')}, 'p', {_text('l.l_partkey')}) AS destination,
  CASE WHEN l.l_quantity = 50 THEN 'Accueil' WHEN l.l_quantity = 49 THEN '12' WHEN l.l_quantity = 48 THEN 'TV'
       WHEN l.l_quantity = 47 THEN 'abc'
       WHEN l.l_quantity = 46 THEN concat('guide complet pour bien choisir et entretenir votre ', p.p_name)
       WHEN l.l_quantity = 45 THEN concat('promo promo promo ', p.p_name) WHEN l.l_quantity = 44 THEN ''
       WHEN l.l_quantity = 43 THEN '{SITE}x' WHEN l.l_quantity = 42 THEN 'En savoir plus'
       ELSE concat(p.p_name, ' ', lower(p.p_type)) END AS anchor,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 2 THEN 'Navigation'
       WHEN l.l_returnflag = 'N' AND l.l_linenumber = 3 THEN 'Pied de page' ELSE 'Contenu' END AS origin,
  CASE WHEN l.l_linenumber = 4 THEN '/html/body/aside/div/a' ELSE '/html/body/main/article/p/a' END AS path
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""

# Titles and H1: equal, equal after strip, one word more, no h1, no title, unrelated.
FIXTURES["fx_page_attrs"] = """
SELECT url,
  CASE page_id % 6 WHEN 4 THEN '' ELSE ti END AS title,
  CASE page_id % 6 WHEN 1 THEN concat('  ', ti, ' ') WHEN 2 THEN concat(ti, ' plus') WHEN 3 THEN ''
                   WHEN 5 THEN 'autre chose' ELSE ti END AS h1
FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS ti FROM pages) t
"""

# Word counts of the whole texts, as text; some unreadable, some negative.
_COUNTED = """
SELECT concat('{site}guide/p', {id}) AS url,
  CASE WHEN doc_id % 50 = 0 THEN 'n/a' WHEN doc_id % 50 = 1 THEN '-5' ELSE {words} END AS word_count
FROM documents
"""
FIXTURES["fx_word_counts"] = (
    _COUNTED.format(
        site=SITE, id=_text("doc_id"), words=_text("size(filter(split(coalesce(text, ''), '[ \\\\t\\\\n\\\\r]+'), w -> w <> ''))")
    ),
    _COUNTED.format(
        site=SITE, id=_text("doc_id"), words=_text("len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> ''))")
    ),
)

# Given clusters: ten large ones, four of a single page, some pages without cluster.
FIXTURES["fx_clusters"] = f"""
SELECT concat('{SITE}guide/p', {_text('vec_id')}) AS url,
  CASE WHEN vec_id < 4 THEN concat('solo', {_text('vec_id')}) WHEN vec_id % 25 = 0 THEN NULL
       ELSE concat('c', {_text('label')}) END AS cluster_id
FROM embeddings
"""

# Link labels: some agree with the class rules, some contradict them; many repeat.
FIXTURES["fx_labels"] = """
SELECT source AS page_url, destination AS href, anchor AS text,
  CASE l_linenumber % 4 WHEN 0 THEN 'EDITORIAL' WHEN 1 THEN 'NAVIGATION' WHEN 2 THEN 'SIDEBAR' ELSE 'CALL_TO_ACTION' END
    AS category,
  CAST(0.5 + l_linenumber / 20.0 AS DOUBLE) AS confidence
FROM fx_links
"""

# URL list with everything a crawl meets.
FIXTURES["fx_urls"] = f"""
SELECT source AS url FROM fx_links UNION SELECT destination FROM fx_links UNION SELECT url FROM pages
UNION SELECT concat(url, '/tag/x') FROM pages
UNION SELECT concat('{SITE}wp-admin/a', {_text('page_id')}) FROM pages
UNION SELECT concat('mailto:a', {_text('page_id')}, '@{HOST}') FROM pages
"""

# Pages with a title, for the search of conversion pages.
FIXTURES["fx_internal_pages"] = """
SELECT source AS url, max(anchor) AS title FROM fx_links GROUP BY source
"""

# Similar pages as a crawler exports them: scores as text, some unreadable.
FIXTURES["fx_similar_pairs"] = f"""
SELECT concat('{SITE}guide/p', {_text('l_orderkey')}) AS source,
  CASE WHEN l_linenumber = 6 AND l_tax = 0 THEN '' ELSE concat('{SITE}guide/p', {_text('l_partkey')}) END AS target,
  CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN 'n/a'
       ELSE concat('0.', {_text('CAST(l_quantity AS INTEGER) + 49')}) END AS similarity
FROM lineitem
"""

# Attributes of the linked pages as a long table; one attribute with an older value per page.
_PART_URL = f"concat('{SITE}', {_section('p_partkey')}, 'p', {_text('p_partkey')})"
FIXTURES["fx_part_attrs"] = f"""
SELECT {_PART_URL} AS url, 'titles' AS attr, concat(p_name, ' ', lower(p_type)) AS value, 2 AS ord FROM part
UNION ALL SELECT {_PART_URL}, 'titles', 'ancien titre', 1 FROM part
UNION ALL SELECT {_PART_URL}, 'h1', p_name, 1 FROM part
UNION ALL SELECT {_PART_URL}, 'h2', CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE concat('autour de ', p_name) END, 1 FROM part
UNION ALL SELECT {_PART_URL}, 'meta_desc', concat(lower(p_type), ' ', p_brand), 1 FROM part
UNION ALL SELECT {_PART_URL}, 'meta_keywords', CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END, 1 FROM part
UNION ALL SELECT {_PART_URL}, 'images_alt', concat('photo ', p_name), 1 FROM part
"""

# Sitemaps of all pages: one per 100 pages, an index per 10 sitemaps that also names
# the next index, so the depth grows with the pages.
FIXTURES["fx_sitemaps"] = (
    """
SELECT concat('https://maps.example/s', CAST(page_id DIV 100 AS STRING), '.xml') AS sitemap_url,
  concat('<urlset>', listagg(concat('<url><loc> ', url, ' </loc></url><url><loc>ftp-is-not-kept</loc></url>'), '')
         WITHIN GROUP (ORDER BY page_id), '</urlset>') AS xml
FROM pages GROUP BY page_id DIV 100
UNION ALL
SELECT concat('https://maps.example/i', CAST(s DIV 10 AS STRING), '.xml'),
  concat('<sitemapindex>', listagg(concat('<sitemap><loc>https://maps.example/s', CAST(s AS STRING), '.xml</loc></sitemap>'), '')
         WITHIN GROUP (ORDER BY s), '<sitemap><loc>https://maps.example/i', CAST(s DIV 10 + 1 AS STRING), '.xml</loc></sitemap></sitemapindex>')
FROM (SELECT DISTINCT page_id DIV 100 AS s FROM pages) t GROUP BY s DIV 10
UNION ALL
SELECT 'https://maps.example/index.xml', '<sitemapindex><sitemap><loc>https://maps.example/i0.xml</loc></sitemap></sitemapindex>'
""",
    # The oracles of the sitemap queries work on page_id alone and need no XML.
    "SELECT 1 AS unused",
)

# A robots file per page host.
FIXTURES["fx_robots"] = """
SELECT concat('https://', host, '/robots.txt') AS robots_url,
  concat('User-agent: *\nDisallow: /admin\nSitemap: https://', host, '/sitemap.xml\nsitemap: https://', host, '/news.xml ') AS body
FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages) t
"""

# Pages with nested zones around the delivered titles: links in main, in an aside, under a menu
# class, close to and far from a menu id, with a short text, and in nested main and article.
FIXTURES["fx_nested_pages"] = f"""
SELECT page_id, concat('https://www.shop.example/n/', {_text('page_id')}) AS url,
  concat('<html><head><title>t</title></head><body><nav><a href="/home">Accueil</a></nav><main><article><p>x <a href="/a',
    {_text('page_id')}, '">guide bois ', {_text('page_id')}, '</a></p></article><aside><a href="/b">voisin</a></aside>',
    '<div class="side-menu"><a href="/c">rayon</a></div><p><a href="/d">ok</a></p></main>',
    '<article><div id="menu1"><div><div><div><div><a href="/e">proche menu</a><div><a href="../f',
    {_text('page_id')}, '">loin du menu</a></div></div></div></div></div></div></article></body></html>') AS html
FROM pages
"""

# The pages that hold the exported links: lines 1 and 2 of a page stand in its navigation.
_LINK_ITEM = """concat('<p>voir <a href="', destination, '">', anchor, CASE WHEN l_linenumber = 5 THEN ' en stock' ELSE '' END, '</a></p>')"""
FIXTURES["fx_link_pages"] = (
    f"""
SELECT source AS url, concat('<html><body><nav>',
  listagg(CASE WHEN l_linenumber <= 2 THEN {_LINK_ITEM} ELSE '' END, '') WITHIN GROUP (ORDER BY l_linenumber),
  '</nav><main>',
  listagg(CASE WHEN l_linenumber > 2 THEN {_LINK_ITEM} ELSE '' END, '') WITHIN GROUP (ORDER BY l_linenumber),
  '</main></body></html>') AS html
FROM fx_links GROUP BY source
""",
    "SELECT 1 AS unused",
)

# Page vectors: each of the delivered vectors mixed with that of one of forty themes; the vector's number names the page.
FIXTURES["fx_page_vectors"] = (
    f"""
SELECT concat('{SITE}guide/p', {_text('e.vec_id')}) AS id,
  zip_with(a.embedding, e.embedding, (x, y) -> CAST(x AS DOUBLE) * e.w + CAST(y AS DOUBLE) * (1D - e.w)) AS embedding
FROM (SELECT vec_id, embedding, CASE vec_id % 3 WHEN 0 THEN 0.9D WHEN 1 THEN 0.7D ELSE 0.5D END AS w FROM embeddings) e
JOIN embeddings a ON a.vec_id = e.vec_id % 40
""",
    f"""
SELECT concat('{SITE}guide/p', {_text('e.vec_id')}) AS id,
  list_transform(list_zip(a.embedding, e.embedding), lambda z: z[1]::DOUBLE * e.w + z[2]::DOUBLE * (1 - e.w)) AS embedding
FROM (SELECT vec_id, embedding, CASE vec_id % 3 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS w FROM embeddings) e
JOIN embeddings a ON a.vec_id = e.vec_id % 40
""",
)

# Texts to embed, and the part of them that a cache already holds.
FIXTURES["fx_texts"] = """
SELECT anchor AS text FROM fx_links UNION ALL SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages
"""

# Anchors with many wordings of the same thing, as a varied site has them.
FIXTURES["fx_theme_anchors"] = """
SELECT anchor, CAST(sum(n) AS BIGINT) AS links FROM (
  SELECT ti AS anchor, 1 + page_id % 3 AS n FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS ti FROM pages) a
  UNION ALL SELECT concat(ti, ' plus'), 1 FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS ti FROM pages) b
  UNION ALL SELECT concat('voir ', ti), 2 FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS ti FROM pages) c
) t GROUP BY anchor
"""

# Anchors of a site with one dominant subject: two words weigh more than the five of the title, and one anchor stands apart.
FIXTURES["fx_dominant_anchors"] = f"""
SELECT anchor, CAST(sum(n) AS BIGINT) AS links FROM (
  SELECT concat('guide guide guide guide bois bois', {", ".join(f"' ', split_part(ti, ' ', {n})" for n in range(1, 6))}) AS anchor, 1 AS n
  FROM (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS ti FROM pages) a
  UNION ALL SELECT 'mentions imprimeur', 1
) t GROUP BY anchor
"""

# Links of a site whose anchors vary: every page links to three others with wordings of their titles.
_TITLED = "(SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS ti, (SELECT count(*) FROM pages) AS n FROM pages)"
FIXTURES["fx_varied_links"] = "\nUNION ALL ".join(
    f"""SELECT concat('{SITE}guide/p', {_text(f'CASE WHEN page_id + {k} < n THEN page_id + {k} ELSE page_id + {k} - n END')}) AS source,
  concat('{SITE}guide/p', {_text('page_id')}) AS destination, {anchor} AS anchor, 'Contenu' AS origin, '/html/body/main/p/a' AS path
FROM {_TITLED} t{k}"""
    for k, anchor in enumerate(("ti", "concat(ti, ' plus')", "concat('voir ', ti)"), 1)
)
FIXTURES["fx_varied_attrs"] = f"""
SELECT concat('{SITE}guide/p', {_text('page_id')}) AS url, 'titles' AS attr, ti AS value, 1 AS ord FROM {_TITLED} a
UNION ALL SELECT concat('{SITE}guide/p', {_text('page_id')}), 'h1', split_part(ti, ' ', 2), 1 FROM {_TITLED} b
UNION ALL SELECT concat('{SITE}guide/p', {_text('page_id')}), 'images_alt', concat('photo ', ti), 1 FROM {_TITLED} c
"""

NEEDS = {
    "fx_labels": ("fx_links",),
    "fx_urls": ("fx_links",),
    "fx_internal_pages": ("fx_links",),
    "fx_link_pages": ("fx_links",),
    "fx_texts": ("fx_links",),
}


#: Fixtures that stand for stored exports: written once per session, then read like any table.
STAGED = ("fx_links", "fx_link_pages")
_staged: dict[tuple[str, str, str], tuple[str, object]] = {}


def register_table(spark, sf_dir: str, table: str):
    """A delivered table, also as a temporary view.

    ``spark.linkaudit.inputPartitions`` deals the large tables to so many partitions, where they come as
    few files; without it they are read as they are.
    """
    data = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    partitions = spark.conf.get("spark.linkaudit.inputPartitions", None)
    if partitions and table in ("lineitem", "pages", "documents"):
        data = data.repartition(int(partitions))
    data.createOrReplaceTempView(table)
    return data


def fixture(spark, sf_dir: str, name: str):
    """A fixture as a DataFrame over the tables of ``sf_dir``."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _staged:
        folder, schema = _staged[key]
        return spark.read.schema(schema).parquet(folder)
    sql = FIXTURES[name]
    sql = sql[0] if isinstance(sql, tuple) else sql
    for table in ("lineitem", "part", "pages", "documents", "embeddings"):
        if f" {table}" in sql:
            register_table(spark, sf_dir, table)
    for needed in NEEDS.get(name, ()):
        fixture(spark, sf_dir, needed).createOrReplaceTempView(needed)
    table = spark.sql(sql)
    if name not in STAGED:
        return table
    folder = f"{checkpoint_dir(spark).rstrip('/')}/linkaudit-{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        table.write.parquet(folder)
    _staged[key] = folder, table.schema
    return spark.read.schema(table.schema).parquet(folder)


def duckdb_with(*names: str) -> str:
    """A WITH clause that defines the fixtures for DuckDB."""
    ordered: list[str] = []
    for name in names:
        for n in (*NEEDS.get(name, ()), name):
            if n not in ordered:
                ordered.append(n)
    bodies = [(n, FIXTURES[n][1] if isinstance(FIXTURES[n], tuple) else FIXTURES[n]) for n in ordered]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({sql.strip()})" for n, sql in bodies)
