"""HTML and URL operators as Column expressions.

Text extraction follows the standard HTML text walk: comments, the doctype
and script/style/template blocks are left out, tags are dropped and
character references are decoded in a single left-to-right pass (so
``&amp;lt;`` gives ``&lt;``). Markup is first replaced by a NUL mark so a
reference can never form across a tag (``&am<b>p;``), then the mark is
deleted (T1) or a run of marks becomes one space (T2).
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexprep import constants as C

MARK = "\u0000"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


_MAP_CACHE: dict = {}


def _json_map(d: dict) -> Column:
    # one literal, folded to a constant map by the optimizer
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in d.items()})), "map<string,string>")


def _maps():
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    key = sc.applicationId if sc is not None else None  # Columns are bound to one running context
    if key not in _MAP_CACHE:
        legacy = C.html_legacy_entities()
        _MAP_CACHE[key] = (_json_map(C.html_named_entities()), _json_map(legacy),
                           _json_map(C.invalid_charrefs()), max(len(k) for k in legacy))
    return _MAP_CACHE[key]


def _codepoint_text(num: Column) -> Column:
    _, _, charref_map, _ = _maps()
    utf32 = F.decode(F.unhex(F.lpad(F.hex(num), 8, "0")), "UTF-32")
    return F.coalesce(
        F.try_element_at(charref_map, num.cast("string")),
        F.when(((num >= 0xD800) & (num <= 0xDFFF)) | (num > 0x10FFFF), F.lit("�"))
        .when(num.isin(C.invalid_codepoints()), F.lit(""))
        .otherwise(utf32),
    )


def _decode_reference(ref: Column) -> Column:
    """One matched reference (starting with '&') to its text."""
    named_map, legacy_map, _, legacy_max = _maps()
    s = ref.substr(F.lit(2), F.length(ref))
    is_num = s.startswith("#")
    is_hex = s.startswith("#x") | s.startswith("#X")
    digits = F.regexp_extract(s, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
    num = (
        F.when(F.length(digits) > 12, F.lit(0x110000))
        .when(F.length(digits) == 0, F.lit(0))
        .when(is_hex, F.conv(digits, 16, 10).try_cast("long"))
        .otherwise(digits.try_cast("long"))
    ).cast("long")
    # a name that is not a full reference may start with a legacy name
    # (longest first) that decodes without ';'
    prefixes = [
        F.when(F.length(s) > k, F.concat(F.try_element_at(legacy_map, s.substr(F.lit(1), F.lit(k))),
                                         s.substr(F.lit(k + 1), F.length(s))))
        for k in range(legacy_max, 1, -1)
    ]
    named = F.coalesce(F.try_element_at(named_map, s), *prefixes, ref)
    return F.when(is_num, _codepoint_text(num)).otherwise(named)


def decode_entities(col) -> Column:
    """Single-pass character-reference decoding of text."""
    c = _c(col)
    refs = F.regexp_extract_all(c, F.lit(C.CHARREF), 0)
    pieces = F.split(c, C.CHARREF, -1)
    tail = F.zip_with(F.transform(refs, _decode_reference), F.slice(pieces, 2, F.size(pieces)),
                      lambda d, p: F.concat(d, p))
    return F.when(c.contains("&"), F.concat(F.get(pieces, 0), F.array_join(tail, ""))).otherwise(c)


def _marked(col) -> Column:
    return decode_entities(F.regexp_replace(_c(col), C.MARKUP_JAVA, MARK))


def html_text(col) -> Column:
    """Text of the document, no separator between text nodes."""
    return F.translate(_marked(col), MARK, "")


def html_text_spaced(col) -> Column:
    """Text nodes joined by one space."""
    return F.regexp_replace(F.btrim(_marked(col), F.lit(MARK)), MARK + "+", " ")


def with_html_text(df, html_col: str, out: str, spaced: bool = False):
    """T1, or T2 if ``spaced``, as staged projections: the markup is marked
    once and the decoder refers to the result."""
    staged = df.withColumn("_m", F.regexp_replace(F.col(html_col), C.MARKUP_JAVA, MARK)).withColumn("_d", decode_entities("_m"))
    text = F.regexp_replace(F.btrim("_d", F.lit(MARK)), MARK + "+", " ") if spaced else F.translate("_d", MARK, "")
    return staged.withColumn(out, text).drop("_m", "_d")


# -- T4 anchors ---------------------------------------------------------------

def _attr(tag: Column, name: str) -> Column:
    pat = rf"(?is)[\s\"'/]{name}\s*=+\s*(?:\"([^\"]*)\"|'([^']*)'|([^>\s\"']*))"
    value = F.concat(F.regexp_extract(tag, pat, 1), F.regexp_extract(tag, pat, 2), F.regexp_extract(tag, pat, 3))
    return F.when(tag.rlike(pat), decode_entities(value))


def anchors(col) -> Column:
    """T4: ``<a>`` tags in document order as array<struct<href, title>>;
    tags inside comments or script blocks are not links."""
    visible = F.regexp_replace(_c(col), C.HIDDEN_JAVA, MARK)
    tags = F.regexp_extract_all(visible, F.lit(C.ANCHOR_JAVA), 0)
    return F.transform(tags, lambda t: F.struct(_attr(t, "href").alias("href"), _attr(t, "title").alias("title")))


# -- T5 / T6 / T7 -------------------------------------------------------------

def url_netloc(col) -> Column:
    return F.regexp_extract(F.coalesce(_c(col), F.lit("")), C.URL_SPLIT, 2)


def url_path(col) -> Column:
    return F.regexp_extract(F.coalesce(_c(col), F.lit("")), C.URL_SPLIT, 3)


def link_terms(href, title, add_title: bool = False, domain: str = C.LINK_DOMAIN) -> Column:
    """For a link on the target domain with at least three path
    segments: optional ' title', ' seg1_seg2', ' seg3' with '-' -> '_'."""
    href, title = _c(href), _c(title)
    items = F.split(url_path(href), "/", -1)
    item1 = F.concat(F.get(items, 1), F.lit("_"), F.get(items, 2))
    item2 = F.get(items, 3)
    parts = [
        F.when(F.lit(add_title) & F.coalesce(title, F.lit("")).__ne__(""), F.concat(F.lit(" "), title))
        .otherwise(F.lit("")),
        F.concat(F.lit(" "), item1),
        F.when(item2 != "", F.concat(F.lit(" "), F.replace(item2, F.lit("-"), F.lit("_")))).otherwise(F.lit("")),
    ]
    ok = url_netloc(href).contains(domain) & (F.size(items) >= 4)
    return F.when(ok, F.concat(*parts)).otherwise(F.lit(""))


def clean_url(col, add_title: bool = False, domain: str = C.LINK_DOMAIN, links: str = "last") -> Column:
    """With no ``<a>`` the input comes back as is; otherwise the spaced
    text plus the terms of the last link (``links='all'``: of every link)."""
    c = _c(col)
    a = anchors(c)
    if links == "last":
        last = F.try_element_at(a, F.lit(-1))
        terms = link_terms(last["href"], last["title"], add_title, domain)
    else:
        terms = F.array_join(F.filter(F.transform(a, lambda x: link_terms(x["href"], x["title"], add_title, domain)),
                                      lambda t: t != ""), " ")
    spaced = html_text_spaced(c)
    return (F.when(F.size(a) == 0, c)
            .otherwise(F.concat(spaced, F.when(terms != "", F.concat(F.lit(" "), terms)).otherwise(F.lit("")))))


def with_clean_url(df, html_col: str, out: str, add_title: bool = False, domain: str = C.LINK_DOMAIN,
                   links: str = "last"):
    """T7 as staged projections: the anchors and the chosen link's terms are
    computed once and referenced (the optimizer keeps the stages apart
    because they are reused), instead of re-running the anchor scan for
    every reference."""
    html = F.col(html_col)
    staged = with_html_text(df, html_col, "_s", spaced=True).withColumn("_a", anchors(html))
    if links == "last":
        staged = staged.withColumn("_l", F.try_element_at(F.col("_a"), F.lit(-1))).withColumn(
            "_t", link_terms(F.col("_l.href"), F.col("_l.title"), add_title, domain))
    else:
        staged = staged.withColumn("_l", F.lit(None)).withColumn("_t", F.array_join(F.filter(
            F.transform("_a", lambda x: link_terms(x["href"], x["title"], add_title, domain)), lambda t: t != ""), " "))
    t = F.col("_t")
    result = (F.when(F.size("_a") == 0, html)
              .otherwise(F.concat(F.col("_s"), F.when(t != "", F.concat(F.lit(" "), t)).otherwise(F.lit("")))))
    return staged.withColumn(out, result).drop("_a", "_l", "_t", "_s")
