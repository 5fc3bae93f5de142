"""Composite cleaning (T13, T17) and hand features (T25) on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexprep import constants as C
from lexprep.functions import html as H
from lexprep.functions import text as T
from lexprep.options import CleanOptions


def extracted_text(html_col, opts: CleanOptions = CleanOptions()) -> Column:
    """First step of T13: links kept as terms (T7) or plain text."""
    if opts.keep_url:
        return H.clean_url(html_col, opts.keep_title, opts.link_domain, opts.links)
    return H.html_text(html_col)


def clean_text(html_col, opts: CleanOptions = CleanOptions()) -> Column:
    """Extract -> punctuation -> lowercase -> tokens minus short words
    and stopwords -> one space. A single projection."""
    stop = C.clean_stopwords(opts.stopword_language, opts.extend_stopwords)
    return T.clean_plain_text(extracted_text(html_col, opts), stop)


def light_prep(html_col, opts: CleanOptions = CleanOptions()) -> Column:
    """Links kept as terms (T7), or tags replaced by a space."""
    if opts.keep_url:
        return H.clean_url(html_col, opts.keep_title, opts.link_domain, opts.links)
    return T.strip_tags(html_col)


def with_clean_text(df: DataFrame, html_col: str = "html", out: str = "text",
                    opts: CleanOptions = CleanOptions()) -> DataFrame:
    """T13 on a DataFrame; the link step or the markup step is staged."""
    stop = C.clean_stopwords(opts.stopword_language, opts.extend_stopwords)
    if opts.keep_url:
        staged = H.with_clean_url(df, html_col, "_u", opts.keep_title, opts.link_domain, opts.links)
    else:
        staged = H.with_html_text(df, html_col, "_u")
    return staged.withColumn(out, T.clean_plain_text("_u", stop)).drop("_u")


def with_light_prep(df: DataFrame, html_col: str = "html", out: str = "text",
                    opts: CleanOptions = CleanOptions()) -> DataFrame:
    """T17 on a DataFrame (staged link step)."""
    if opts.keep_url:
        return H.with_clean_url(df, html_col, out, opts.keep_title, opts.link_domain, opts.links)
    return df.withColumn(out, T.strip_tags(html_col))


def hand_features(df: DataFrame, text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """The three counts are computed once in an inner projection
    and reused by the ratios (the original runs each regex twice)."""
    keys = keys or ["doc_id"]
    t = F.col(text_col)
    counts = df.select(*keys, T.law_count(t).cast("long").alias("freq_law"),
                       T.term_count(t).cast("long").alias("freq_term"),
                       T.phrase_count(t).cast("long").alias("freq_phrase"),
                       F.char_length(t).cast("long").alias("len_doc"))
    n = F.col("len_doc")
    return counts.select(*keys, "freq_law", "freq_term", "freq_phrase", "len_doc",
                         F.try_divide(F.col("freq_law").cast("double"), n).alias("ratio_law"),
                         F.try_divide(F.col("freq_term").cast("double"), n).alias("ratio_term"),
                         F.try_divide(F.col("freq_phrase").cast("double"), n).alias("ratio_phrase"))
