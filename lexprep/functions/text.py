"""String operators as Column -> Column expressions (all JVM-side).

Python's regex dialect is restated in Java terms (see constants): ``\\w`` is
an explicit Unicode class, ``.`` gets ``(?d)`` so it excludes only ``\\n``,
case-insensitive matching with accents gets ``(?iu)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexprep import constants as C


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# -- T8 / T9 / T10 ------------------------------------------------------------

def remove_punctuation(col) -> Column:
    """Each of the 28 ASCII punctuation characters becomes a space."""
    return F.translate(_c(col), C.PUNCTUATION, " " * len(C.PUNCTUATION))


def whitespace_tokens(col) -> Column:
    """Python ``str.split()``: split on whitespace runs, no empty tokens."""
    return F.filter(F.split(_c(col), C.WS_RUN, -1), lambda t: t != F.lit(""))


def drop_short_and_stopwords(tokens: Column, stopwords: list[str]) -> Column:
    """T10 filter: keep tokens longer than one character and not stopwords.
    Order and repeats are kept (not array_except, which dedupes)."""
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(stopwords))


def clean_plain_text(col, stopwords: list[str]) -> Column:
    """T8 -> T9 -> T10 on already extracted text; one projection."""
    lowered = F.lower(remove_punctuation(col))
    return F.array_join(drop_short_and_stopwords(whitespace_tokens(lowered), stopwords), " ")


def single_space_split(col) -> Column:
    """``str.split(' ')`` keeps empty strings."""
    return F.split(_c(col), " ", -1)


# -- T3 -----------------------------------------------------------------------

def strip_tags(col) -> Column:
    """Every ``<...>`` on one line becomes a space (lazy, no newline)."""
    return F.regexp_replace(_c(col), r"(?d)<.*?>", " ")


# -- T11 / T12 ----------------------------------------------------------------

def strip_accents_word(col) -> Column:
    """Canonical decomposition, then every non-ASCII character dropped.
    The decomposition is a translate() table derived from unicodedata."""
    src, dst = C.accent_fold_table()
    return F.regexp_replace(F.translate(_c(col), src, dst), r"[^\x00-\x7F]", "")


def strip_accents(col) -> Column:
    """Per whitespace token, joined by one space. Folding the joined
    string equals folding each token: the separator is ASCII and no
    character folds to whitespace."""
    return strip_accents_word(F.array_join(whitespace_tokens(col), " "))


# -- T14 ----------------------------------------------------------------------

_PARTY_GUARD = "RECORR|AGRAV|EMBARG|SUSCITA|RELATOR|ADVOGADO"


def remove_parties(col) -> Column:
    """42 ordered deletions ``TERM.+?(?=CLOSE)``; rows without any
    party term skip the chain (every rule starts with one of them), and a
    rule is tried only on a text with a closing after its first term."""
    c = _c(col)
    rules = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(e).alias("close"), F.lit(f"(?d){t}.+?(?={e})").alias("cut"))
                      for t, e in C.party_rules()])

    def apply(text, rule):
        at = F.instr(text, rule["term"])
        closed = (at > 0) & F.substr(text, at).contains(rule["close"])
        return F.when(closed, F.regexp_replace(text, rule["cut"], F.lit(""))).otherwise(text)

    return F.when(c.rlike(_PARTY_GUARD), F.aggregate(rules, c, apply)).otherwise(c)


# -- T18 / T19 ----------------------------------------------------------------

def replace_entities(col, entities, replacement: str) -> Column:
    """Each entity string replaced everywhere, in list order."""
    return F.aggregate(_c(entities), _c(col), lambda acc, x: F.replace(acc, x, F.lit(replacement)))


def remove_names(col, entities) -> Column:
    """T18"""
    return replace_entities(col, entities, "")


def mask_names(col, entities) -> Column:
    """T19"""
    return replace_entities(col, entities, C.NAME_MASK)


# -- T20 - T25 ----------------------------------------------------------------

W = C.WORD
# a match begins where its word run does: tried from there only, a long run costs one scan, not one from each letter
LAW_JAVA = f"(?diu)(?<!{W}){W}*{C.LAW_CORE}{W}*"
TERM_JAVA = f"(?iu)(?<!{W}){W}*{C.TERM_CORE}{W}*"
PHRASE_JAVA = f"(?iu)(?<!{W}){W}*{C.PHRASE_CORE}{W}*"


def law_count(col) -> Column:
    """T20. The cheap ``contains`` guard skips the backtracking scan on
    texts that cannot match (exact: any match contains '709')."""
    c = _c(col)
    return F.when(c.contains("709"), F.regexp_count(c, F.lit(LAW_JAVA))).otherwise(F.lit(0))


def term_count(col) -> Column:
    """T21"""
    c = _c(col)
    return F.when(F.lower(c).contains("lgpd"), F.regexp_count(c, F.lit(TERM_JAVA))).otherwise(F.lit(0))


def phrase_count(col) -> Column:
    """T22"""
    c = _c(col)
    return F.when(F.lower(c).contains("dado"), F.regexp_count(c, F.lit(PHRASE_JAVA))).otherwise(F.lit(0))


def hand_feature_columns(col) -> list[Column]:
    """T25 in order: law, term, phrase, length, three ratios (null for an
    empty text, where the original divides by zero)."""
    c = _c(col)
    law, term, phrase = law_count(c), term_count(c), phrase_count(c)
    n = F.char_length(c)
    return [
        law.cast("long").alias("freq_law"),
        term.cast("long").alias("freq_term"),
        phrase.cast("long").alias("freq_phrase"),
        n.cast("long").alias("len_doc"),
        F.try_divide(law.cast("double"), n).alias("ratio_law"),
        F.try_divide(term.cast("double"), n).alias("ratio_term"),
        F.try_divide(phrase.cast("double"), n).alias("ratio_phrase"),
    ]
