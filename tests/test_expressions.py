from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from linkaudit.functions import text, urls, vectors

TEXTS = ["", " ", "a", "  Été   ", " vide　", "un  deux\ttrois\nquatre", "L'Eau vive", "\x1cx\x1f", "a b"]


def test_strip_and_words_follow_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", text.py_strip(F.col("t")).alias("s"), text.py_words(F.col("t")).alias("w")).collect():
        assert r.s == r.t.strip()
        assert r.w == r.t.split()


@pytest.mark.parametrize("a,b", [("a b c", "A B c d"), ("", "x"), (" ", " "), ("é f", "É F"), ("a a b", "a b b")])
def test_jaccard(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    sa, sb = set(a.lower().split()), set(b.lower().split())
    want = len(sa & sb) / len(sa | sb) if sa and sb else 0.0
    assert df.select(text.jaccard_words(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_ngrams_of_short_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(text.ngrams(F.col("w"), 2)).collect()]
    assert got == [["a b", "b c"], [], []]


def test_truncate(spark):
    df = spark.createDataFrame([("x" * 50,), ("x" * 51,)], "t string")
    assert [r[0] for r in df.select(text.truncate(F.col("t"), 50)).collect()] == ["x" * 50, "x" * 50 + "..."]


def test_matches_any_anchors_and_alternatives(spark):
    df = spark.createDataFrame([(t,) for t in ["PRÉCÉDENT", "xprécédent", "b", "ab", "12", "a12"]], "t string")
    got = [r[0] for r in df.select(text.matches_any(F.col("t"), [r"^précédent$", r"^a$|b", r"^\d+$"])).collect()]
    assert got == [True, False, True, True, True, False]
    assert df.select(text.matches_any(F.col("t"), [])).first()[0] is False


URLS = [
    "https://u:p@Host.fr:80/a/b?q=//x#f", "http://h", "//h/p", "/rel/path", "", "mailto:a@b", "https://a b.fr/x", "HTTP://H/",
    "http://h?x=1", "http://h#f", "x:y//z", "ftp://h/p",
]


def test_host_and_path_follow_urlparse(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    for r in df.select("u", urls.url_host(F.col("u")).alias("h"), urls.url_path(F.col("u")).alias("p")).collect():
        parsed = urlparse(r.u)
        assert r.h == parsed.netloc, r.u
        if ";" not in r.u:
            assert r.p == parsed.path, r.u


REFS = "g ./g g/ /g //g ?y g?y #s g#s . ./ .. ../ ../g ../../g ../../../g /./g /../g g. ..g http://x/y mailto:z g/./h g/../h".split() + [""]


@pytest.mark.parametrize("base", ["http://a/b/c/d?q", "http://a/b/c/", "http://a", "https://www.a.fr/x.html"])
def test_join_follows_urljoin(spark, base):
    df = spark.createDataFrame([(base, r) for r in REFS], "b string, r string")
    for row in df.select("b", "r", urls.url_join(F.col("b"), F.col("r")).alias("j")).collect():
        assert row.j == urljoin(row.b, row.r), (row.b, row.r)


def test_label(spark):
    df = spark.createDataFrame([("https://h/",), ("https://h/a/",), ("https://h/" + "x" * 40,)], "u string")
    got = [r[0] for r in df.select(urls.url_label(F.col("u"))).collect()]
    assert got == ["/", "/a", "/" + "x" * 26 + "..."]


def test_cosine_and_hashed_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(2**-0.5), 0.0]
    words = spark.createDataFrame([("ab",), ("abc abc d",), ("  ",)], "t string")
    sums = [sum(r[0]) for r in words.select(vectors.hashed_vector(F.col("t"), 16)).collect()]
    assert sums == [0, 3, 0]
