"""Queries of the HTML and URL operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexprep import constants as C
from lexprep.functions import html as H
from lexprep.operators import cleaning as K
from lexprep.options import CleanOptions
from lexprep.plans import oracle as O
from lexprep.plans.catalog import register
from lexprep.sources import fixtures as X
from lexprep.sources.readers import table


@register("html_text", f"SELECT page_id, {O.html_text_sql('html')} AS text FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", "html").transform(
        H.with_html_text, "html", "text").select("page_id", "text")


@register("html_text_spaced", f"SELECT page_id, {O.html_text_spaced_sql('html')} AS text FROM pages")
def html_text_spaced(spark, sf):
    return table(spark, sf, "pages").select("page_id", "html").transform(
        H.with_html_text, "html", "text", True).select("page_id", "text")


def _attr_sql(tag: str, name: str) -> str:
    pat = O.q(rf"(?is)[\s\"'/]{name}\s*=+\s*(?:\"([^\"]*)\"|'([^']*)'|([^>\s\"']*))")
    value = (f"(regexp_extract({tag}, {pat}, 1) || regexp_extract({tag}, {pat}, 2) "
             f"|| regexp_extract({tag}, {pat}, 3))")
    return f"CASE WHEN regexp_matches({tag}, {pat}) THEN {O.decode_entities_sql(value)} END"


def anchors_sql(src: str, key: str) -> str:
    """(key, pos, tag) rows of the anchors of ``src`` (a relation with html)."""
    visible = f"regexp_replace(html, {O.q(C.HIDDEN_RE2)}, chr(1), 'g')"
    return f"""(SELECT {key}, pos - 1 AS pos, tags[pos] AS tag
   FROM (SELECT {key}, tags, generate_subscripts(tags, 1) AS pos
         FROM (SELECT {key}, regexp_extract_all({visible}, {O.q(C.ANCHOR_RE2)}) AS tags FROM {src})))"""


@register("page_anchors", f"""
SELECT page_id, CAST(pos AS BIGINT) AS pos, {_attr_sql('tag', 'href')} AS href, {_attr_sql('tag', 'title')} AS title
FROM {anchors_sql('pages', 'page_id')}""")
def page_anchors(spark, sf):
    """T4 as rows: one row per <a> of each page, with its position."""
    p = table(spark, sf, "pages").select("page_id", H.anchors("html").alias("a"))
    return p.select("page_id", F.posexplode("a").alias("pos", "a")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "a.href", "a.title")


_URL_RE2 = O.q(C.URL_SPLIT)


@register("url_parts", f"""
SELECT page_id, regexp_extract(url, {_URL_RE2}, 1) AS scheme, regexp_extract(url, {_URL_RE2}, 2) AS netloc,
       regexp_extract(url, {_URL_RE2}, 3) AS path
FROM pages""")
def url_parts(spark, sf):
    """T5 on the page URLs."""
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(u, C.URL_SPLIT, 1).alias("scheme"), H.url_netloc(u).alias("netloc"),
        H.url_path(u).alias("path"))


def link_terms_sql(href: str, title: str, add_title: bool) -> str:
    h = f"coalesce({href}, '')"
    items = f"string_split(regexp_extract({h}, {_URL_RE2}, 3), '/')"
    t = (f"CASE WHEN coalesce({title}, '') <> '' THEN ' ' || {title} ELSE '' END || " if add_title else "")
    out = (f"{t}' ' || {items}[2] || '_' || {items}[3] || "
           f"CASE WHEN {items}[4] <> '' THEN ' ' || replace({items}[4], '-', '_') ELSE '' END")
    ok = f"contains(regexp_extract({h}, {_URL_RE2}, 2), {O.q(C.LINK_DOMAIN)}) AND len({items}) >= 4"
    return f"(CASE WHEN {ok} THEN {out} ELSE '' END)"


@register("link_terms", O.with_(O.DECISIONS) + f"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, {link_terms_sql('href', 'title', False)} AS terms,
       {link_terms_sql('href', 'title', True)} AS terms_titled
FROM (SELECT doc_id, pos, {_attr_sql('tag', 'href')} AS href, {_attr_sql('tag', 'title')} AS title
      FROM {anchors_sql('decisions', 'doc_id')})""")
def link_terms(spark, sf):
    """T6 for every link of every decision, without and with the title."""
    d = X.decisions(spark, sf).select("doc_id", F.posexplode(H.anchors("html")).alias("pos", "a"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"),
                    H.link_terms("a.href", "a.title", False).alias("terms"),
                    H.link_terms("a.href", "a.title", True).alias("terms_titled"))


def clean_url_sql(src: str, key: str, add_title: bool) -> str:
    """T7 over relation ``src`` (key, html)."""
    last = f"""(SELECT {key}, max_by({link_terms_sql('href', 'title', add_title)}, pos) AS terms, count(*) AS n
      FROM (SELECT {key}, pos, {_attr_sql('tag', 'href')} AS href, {_attr_sql('tag', 'title')} AS title
            FROM {anchors_sql(src, key)}) GROUP BY {key})"""
    return f"""SELECT s.{key},
  CASE WHEN coalesce(l.n, 0) = 0 THEN s.html
       ELSE {O.html_text_spaced_sql('s.html')} || CASE WHEN l.terms <> '' THEN ' ' || l.terms ELSE '' END END AS text
FROM {src} s LEFT JOIN {last} l ON s.{key} = l.{key}"""


@register("clean_url", clean_url_sql("pages", "page_id", False))
def clean_url(spark, sf):
    """T7 on web pages (relative links only: text plus nothing)."""
    p = table(spark, sf, "pages").select("page_id", "html")
    return H.with_clean_url(p, "html", "text", add_title=False).select("page_id", "text")


def clean_url_all_sql(src: str, key: str, add_title: bool) -> str:
    """T7 with the terms of every link, in document order."""
    terms = f"""(SELECT {key}, count(*) AS n, string_agg(t, ' ' ORDER BY pos) FILTER (t <> '') AS terms
      FROM (SELECT {key}, pos, {link_terms_sql('href', 'title', add_title)} AS t
            FROM (SELECT {key}, pos, {_attr_sql('tag', 'href')} AS href, {_attr_sql('tag', 'title')} AS title
                  FROM {anchors_sql(src, key)})) GROUP BY {key})"""
    return f"""SELECT s.{key},
  CASE WHEN coalesce(l.n, 0) = 0 THEN s.html
       ELSE {O.html_text_spaced_sql('s.html')} || CASE WHEN coalesce(l.terms, '') <> '' THEN ' ' || l.terms ELSE '' END END AS text
FROM {src} s LEFT JOIN {terms} l ON s.{key} = l.{key}"""


_DECISIONS = "(SELECT * FROM decisions WHERE html IS NOT NULL)"


@register("clean_url_all", O.with_(O.DECISIONS) + clean_url_all_sql(_DECISIONS, "doc_id", True))
def clean_url_all(spark, sf):
    """T7 with the terms of every link, titles kept, on decisions."""
    d = X.decisions(spark, sf).where(F.col("html").isNotNull()).select("doc_id", "html")
    return H.with_clean_url(d, "html", "text", add_title=True, links="all").select("doc_id", "text")


@register("clean_text_links", O.with_(O.DECISIONS) + f"""
SELECT doc_id, {O.clean_plain_sql('text', C.clean_stopwords())} AS text
FROM ({clean_url_sql(_DECISIONS, 'doc_id', True)})""")
def clean_text_links(spark, sf):
    """T13 with the default options: T7 (links and titles kept), then the plain cleaner."""
    d = X.decisions(spark, sf).where(F.col("html").isNotNull()).select("doc_id", "html")
    return K.with_clean_text(d, "html", "text", CleanOptions()).select("doc_id", "text")


@register("light_prep", O.with_(O.DECISIONS) + clean_url_sql("(SELECT * FROM decisions WHERE html IS NOT NULL)",
                                                            "doc_id", True))
def light_prep(spark, sf):
    """T17 with the default options (links kept, with titles) on decisions."""
    d = X.decisions(spark, sf).where(F.col("html").isNotNull()).select("doc_id", "html")
    return K.with_light_prep(d, "html", "text", CleanOptions(keep_url=True, keep_title=True)).select("doc_id", "text")
