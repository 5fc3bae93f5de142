"""Queries of the string operators (T3, T8-T14, T18-T25) and the cleaner."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexprep import constants as C
from lexprep.functions import text as T
from lexprep.operators import cleaning as K
from lexprep.operators import labels as L
from lexprep.options import PLAIN
from lexprep.plans import oracle as O
from lexprep.plans.catalog import register
from lexprep.sources import fixtures as X
from lexprep.sources.readers import table

STOP = C.clean_stopwords()


@register("remove_punctuation", f"SELECT doc_id, {O.remove_punct_sql('text')} AS text FROM documents")
def remove_punctuation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.remove_punctuation("text").alias("text"))


@register("strip_tags", "SELECT page_id, regexp_replace(html, '<.*?>', ' ', 'g') AS text FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_tags("html").alias("text"))


_SRC, _DST = C.accent_fold_table()


@register("strip_accents", f"""
SELECT doc_id, regexp_replace(translate(array_to_string({O.ws_tokens('text')}, ' '), {O.q(_SRC)}, {O.q(_DST)}),
                              '[^\\x00-\\x7F]', '', 'g') AS text
FROM documents""")
def strip_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.strip_accents("text").alias("text"))


def _parties_sql(x: str) -> str:
    out = x
    for term, close in C.party_rules():
        out = f"regexp_replace({out}, {O.q(term + '.+?(' + close + ')')}, '\\1', 'g')"
    return out


@register("remove_parties", O.with_(O.DECISIONS) + f"""
SELECT doc_id, {_parties_sql('html')} AS html FROM decisions""")
def remove_parties(spark, sf):
    return X.decisions(spark, sf).select("doc_id", T.remove_parties("html").alias("html"))


def _names_sql(mask: str) -> str:
    return (O.with_(O.DECISIONS, O.ENTITIES) + f"""
SELECT d.doc_id, list_reduce(list_prepend(d.html, e.ents), lambda a, x: replace(a, x, {O.q(mask)})) AS html
FROM decisions d JOIN entities e ON d.doc_id = e.doc_id""")


def _names(spark, sf, fn):
    d = X.decisions(spark, sf)
    e = X.entities(spark, sf)
    # both sides are keyed by the document primary key: a plain equi-join
    return d.join(e, "doc_id").select("doc_id", fn("html", "ents").alias("html"))


@register("mask_names", _names_sql(C.NAME_MASK))
def mask_names(spark, sf):
    return _names(spark, sf, T.mask_names)


@register("remove_names", _names_sql(""))
def remove_names(spark, sf):
    return _names(spark, sf, T.remove_names)


def clean_sql(html: str) -> str:
    return O.clean_plain_sql(O.html_text_sql(html), STOP)


@register("clean_text", O.with_(O.DECISIONS) + f"""
SELECT doc_id, corpus, {clean_sql('html')} AS text FROM decisions WHERE html IS NOT NULL""")
def clean_text(spark, sf):
    d = X.decisions(spark, sf).where(F.col("html").isNotNull())
    return K.with_clean_text(d, "html", "text", PLAIN).select("doc_id", "corpus", "text")


@register("labelled_clean", O.with_(O.RESPONSES, O.LATEST, O.GRADED, O.DECISIONS, O.LABELLED) + f"""
SELECT resp_id AS id, {clean_sql('html')} AS text, label FROM labelled WHERE html IS NOT NULL""")
def labelled_clean(spark, sf):
    """P8 + P11: (id, text, label) of the labelled set; the id is the row
    key (the answer id), text is cleaned. A null document cannot be
    cleaned (the original fails on it), so it is left out."""
    ls = L.labelled_set(X.responses(spark, sf), X.decisions(spark, sf)).where(F.col("html").isNotNull())
    return K.with_clean_text(ls, "html", "text", PLAIN).select(F.col("resp_id").alias("id"), "text", "label")


W = C.WORD


def _count_sql(x: str, core: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {O.q('(?i)' + W + '*' + core + W + '*')})) AS BIGINT)"


@register("hand_features", O.with_(O.DECISIONS) + f"""
SELECT doc_id, freq_law, freq_term, freq_phrase, len_doc,
       round(freq_law / nullif(len_doc, 0), 9) AS ratio_law,
       round(freq_term / nullif(len_doc, 0), 9) AS ratio_term,
       round(freq_phrase / nullif(len_doc, 0), 9) AS ratio_phrase
FROM (SELECT doc_id, {_count_sql('t', C.LAW_CORE)} AS freq_law, {_count_sql('t', C.TERM_CORE)} AS freq_term,
             {_count_sql('t', C.PHRASE_CORE)} AS freq_phrase, CAST(length(t) AS BIGINT) AS len_doc
      FROM (SELECT doc_id, {clean_sql('html')} AS t FROM decisions WHERE html IS NOT NULL))""")
def hand_features(spark, sf):
    d = X.decisions(spark, sf).where(F.col("html").isNotNull())
    feats = K.hand_features(K.with_clean_text(d, "html", "text", PLAIN).select("doc_id", "text"))
    return feats.select("doc_id", "freq_law", "freq_term", "freq_phrase", "len_doc",
                        *[F.round(c, 9).alias(c) for c in ("ratio_law", "ratio_term", "ratio_phrase")])


@register("hand_features_raw", O.with_(O.DECISIONS) + f"""
SELECT doc_id, {_count_sql('html', C.LAW_CORE)} AS freq_law, {_count_sql('html', C.TERM_CORE)} AS freq_term,
       {_count_sql('html', C.PHRASE_CORE)} AS freq_phrase, CAST(length(html) AS BIGINT) AS len_doc
FROM decisions WHERE html IS NOT NULL""")
def hand_features_raw(spark, sf):
    """T20-T23 on the uncleaned document (the phrase survives there)."""
    d = X.decisions(spark, sf).where(F.col("html").isNotNull())
    return K.hand_features(d.select("doc_id", F.col("html").alias("text"))).select(
        "doc_id", "freq_law", "freq_term", "freq_phrase", "len_doc")
