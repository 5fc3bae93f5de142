"""HTML/URL operators against Python's html.parser and urllib."""

from html.parser import HTMLParser
from urllib.parse import urlparse

from pyspark.sql import functions as F

from conftest import SF_SMALL, one_col
from lexprep.functions import html as H
from lexprep.operators import labels as L


class _Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template") and self.skip:
            self.skip -= 1

    def handle_data(self, d):
        if not self.skip:
            self.parts.append(d)


def walk(h):
    w = _Walk()
    w.feed(h)
    w.close()
    return w.parts


def test_html_text_matches_parser_on_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    rows = pages.select("html", H.html_text("html").alias("t1"), H.html_text_spaced("html").alias("t2")).collect()
    assert rows
    for r in rows:
        p = walk(r.html)
        assert r.t1 == "".join(p)
        assert r.t2 == " ".join(p)


def test_entity_golden_cases(spark):
    cases = {
        "&#38;amp; &amp;#38; &amp;lt;": "&amp; &#38; &lt;",
        "R&AMPD &amplifier": "R&D &lifier",
        "&am<b>p; x</b>": "&amp; x",
        "a<p t=\"x>y\">b": "ab",
        "&#x1F600; &#128; &notit; &notin; x&lt": "😀 € ¬it; ∉ x<",
    }
    got = [r[0] for r in one_col(spark, list(cases)).select(H.html_text("t")).collect()]
    assert got == list(cases.values())
    for src in list(cases)[:5]:
        assert "".join(walk(src)) == cases[src]


def test_huge_tag_does_not_overflow(spark):
    got = one_col(spark, ["a<p x=" + "y" * 300_000 + ">b"]).select(H.html_text("t")).first()[0]
    assert got == "ab"


def test_link_terms_golden(spark):
    url = "http://www.jusbrasil.com.br/topicos/10619340/artigo-157-do-decreto-lei-n-2848-de-07-de-dezembro-de-1940"
    df = spark.createDataFrame([(url, "Artigo 157"), ("/outro", None), ("http://www.jusbrasil.com.br/a/b", None),
                                (None, None)], "h string, t string")
    got = [r[0] for r in df.select(H.link_terms("h", "t", False)).collect()]
    assert got[0] == " topicos_10619340 artigo_157_do_decreto_lei_n_2848_de_07_de_dezembro_de_1940"
    assert got[1:] == ["", "", ""]
    titled = df.select(H.link_terms("h", "t", True)).first()[0]
    assert titled == " Artigo 157" + got[0]


def test_url_parts_match_urlparse(spark):
    urls = ["http://a.b:80/x/y?q=1#f", "/rel/path", "https://u@h.com", "mailto:x@y", "//host/p", "x y/z", ""]
    got = one_col(spark, urls).select(H.url_netloc("t").alias("n"), H.url_path("t").alias("p")).collect()
    for u, r in zip(urls, got):
        pu = urlparse(u)
        assert (r.n, r.p) == (pu.netloc, pu.path), u


def test_clean_url_without_links_returns_input(spark):
    got = one_col(spark, ["<p>x &amp; y</p>", '<p>a</p><a href="http://www.jusbrasil.com.br/t/1/a-b">l</a>']) \
        .select(H.clean_url("t", add_title=False)).collect()
    assert got[0][0] == "<p>x &amp; y</p>"
    assert got[1][0] == "a l  t_1 a_b"  # parts start with a space: two spaces, as in the original


def test_anchor_attributes(spark):
    h = '<!-- <a href="/hidden"> --><a title=\'T &amp; U\' href=/x>y</a><a>z</a>'
    a = one_col(spark, [h]).select(F.inline(H.anchors("t"))).collect()
    assert [(r.href, r.title) for r in a] == [("/x", "T & U"), (None, None)]


def test_decision_id_golden(spark):
    urls = {
        "https://www.jusbrasil.com.br/jurisprudencia/123/inteiro-teor-456": 456,
        "https://www.jusbrasil.com.br/jurisprudencia/123/agravo-em-recurso": 123,
        "https://tj-sp.jusbrasil.com.br/jurisprudencia/9/x": None,
        "https://www.jusbrasil.com.br/jurisprudencia/123/inteiro-teor-456?ref=a": None,
    }
    got = [r[0] for r in one_col(spark, list(urls)).select(L.decision_id("t")).collect()]
    assert got == list(urls.values())
