import random

import pytest
from pyspark.sql import functions as F

from linkaudit.functions import html as H
from linkaudit.functions.html import LinkScanner, clean_html, html_word_count
from linkaudit.operators import pages as P

NESTED_1 = (
    '<main><article><p>x <a href="/a">guide bois</a></p></article><aside><a href="/b">voisin</a></aside>'
    '<div class="side-menu"><a href="/c">rayon</a></div><p><a href="/d">ok</a></p></main>'
)
NESTED_2 = (
    '<article><div id="menu1"><div><div><div><div><a href="/e">proche menu</a>'
    '<div><a href="/f">loin du menu</a></div></div></div></div></div></div></article>'
)


def content(spark, html, **options):
    pages = spark.createDataFrame([("https://s.fr/n/1", html)], "url string, html string")
    rows = P.content_zone_links(P.extract_page_links(pages, **options)).orderBy("position").collect()
    return [r.href.removeprefix("https://s.fr") for r in rows]


def test_nested_zones(spark):
    assert content(spark, NESTED_1) == ["/a"]
    assert content(spark, NESTED_2) == ["/f"]


def test_section_counts_unless_classes_are_known(spark):
    html = '<section><a href="a">un lien</a></section><div class="x texte"><a href="b">deux liens</a></div>'
    assert content(spark, html) == ["/n/a"]
    assert content(spark, html, zone_classes=("texte",)) == ["/n/b"]


@pytest.mark.parametrize(
    "html,links",
    [
        ('<a href="/a">un <b>deux</b> trois</a>', [("/a", "undeuxtrois")]),
        ('<p><a href="/a">sans fin</p><a href="/b">b</a>', [("/a", "sans fin"), ("/b", "b")]),
        ('<a name="x">pas de lien</a><a href>vide</a>', [("", "vide")]),
        ('<script>var s="<a href=\'/x\'>x</a>"</script><!-- <a href="/c">c</a> --><a href="/a">a &amp; b</a>', [("/a", "a & b")]),
        ('</div><A HREF="/a">A</A><br><img src="x"><a href="/b">B<br>b</a>', [("/a", "A"), ("/b", "Bb")]),
        ('<a href="/a">reste', [("/a", "reste")]),
        ("", []),
    ],
)
def test_scanner(html, links):
    assert [(l["href"], l["text"]) for l in LinkScanner().scan(html)] == links


def test_context_is_the_parent_text():
    long = "mot " * 40
    first, second = LinkScanner().scan(f'<p>avant <a href="/a">ici</a> après</p><p><a href="/b">là</a>{long}</p>')
    assert first["context"] == "avanticiaprès"
    assert second["context"] == ("là" + long.strip())[:100] + "..."


def test_flat_and_nested_extraction_agree(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    nested = P.extract_page_links(pages).select("page_url", "position", "href", "text")
    flat = P.extract_flat_links(pages)
    assert nested.count() == 281
    assert nested.exceptAll(flat).isEmpty() and flat.exceptAll(nested).isEmpty()


def test_match_rules(spark, links_of):
    page = "https://s.fr/p"
    offered = spark.createDataFrame(
        [(page, "https://s.fr/x/", " Guide du Bois "), (page, "https://s.fr/y", "abcd"), ("https://s.fr/q", "https://s.fr/z", "zzzz")],
        "page_url string, href string, text string",
    )
    links = links_of(
        [
            (page, "https://s.fr/x", "Guide du Bois"), (page, "https://s.fr/x//", "bois"), (page, "https://s.fr/x", "ois"),
            (page, "https://s.fr/y", "ABCD"), (page, "https://s.fr/y", "abcde"), (page, "https://s.fr/z", "zzzz"),
            (page, "https://s.fr/x", "Guide du Bois"),
        ]
    )
    kept = sorted((r.destination, r.anchor) for r in P.match_editorial_links(links, offered).collect())
    assert kept == [("https://s.fr/x", "Guide du Bois")] * 2 + [("https://s.fr/x//", "bois"), ("https://s.fr/y", "ABCD")]


def test_match_shuffles_links_and_texts_once(spark, tmp_path, links_of):
    page = "https://s.fr/p"
    links_of([(page, "https://s.fr/x", "bois"), (page, "https://s.fr/x", "bois"), (page, "https://s.fr/x/", "pierre")]).write.parquet(str(tmp_path / "links"))
    offers = [(page, "https://s.fr/x", text) for text in ("guide bois", "guide fer", "guide bois")]
    spark.createDataFrame(offers, "page_url string, href string, text string").write.parquet(str(tmp_path / "offers"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = P.match_editorial_links(spark.read.parquet(str(tmp_path / "links")), spark.read.parquet(str(tmp_path / "offers")), "s.fr")
        assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r.destination, r.anchor) for r in kept.collect()] == [("https://s.fr/x", "bois")] * 2


def test_clean_html_and_words(spark):
    html = "<html><SCRIPT>x</SCRIPT><body class='b'><style>p{}</style>un <b>deux</b><noscript>non</noscript></body></html>"
    row = spark.createDataFrame([(html,)], "h string").select(
        clean_html(F.col("h")).alias("c"), clean_html(F.col("h"), 5).alias("cut"), html_word_count(F.col("h")).alias("n")
    ).first()
    assert row.c == "<body class='b'>un <b>deux</b></body>"
    assert (row.cut, row.n) == ("<body", 2)


def _parsed(scanner, html):
    """The links of a page by the parser alone."""
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(H, "plain_tokens", lambda html: None)
        return scanner.scan(html)


def test_plain_pages_need_no_parser(monkeypatch):
    plain = ["<html><head><title>a page</title></head><body>" + NESTED_1 + "</body></html>", NESTED_2, 'x<a href="">y<br>z</a></p>end']
    scanner = LinkScanner()
    expected = [_parsed(scanner, html) for html in plain]
    monkeypatch.setattr(LinkScanner, "feed", lambda *_: pytest.fail("parsed"))
    assert [scanner.scan(html) for html in plain] == expected and all(expected)


def test_plain_and_parsed_pages_agree():
    pieces = [
        "<p>", "</p>", '<a href="/x">', '<a href="">', "<a>", "</a>", "<nav>", "</nav>", "<main>", "</main>", '<div class="side-menu">', '<div class="box big">',
        '<div id="x1">', "</div>", "<br>", "<br/>", " mot ", "texte long " * 9, "\n", "<aside>", "</aside>", "</x>", "é>", '"', "<title>", "</title>",
    ]
    odd = ["&amp;", "&", "<!-- <a href='/q'>z</a> -->", "<script>a<b</script>", "<", "<A HREF=x>", "<a href='/s'>", '</a x="y">', "<template>", "<p/>", "<a\nhref='/n'>", "<style>"]
    draw, plain = random.Random(5), 0
    for scanner in (LinkScanner(), LinkScanner(("main", "article"), ("box",))):
        for i in range(3000):
            html = "".join(draw.choices(pieces + odd * (i % 3 == 0), k=draw.randint(0, 25)))
            plain += H.plain_tokens(html) is not None
            assert scanner.scan(html) == _parsed(scanner, html), html
    assert plain > 1000
