"""Constants shared by the Spark operators and the DuckDB oracle.

Two dialects are kept side by side: Java regex (Spark) and RE2 (DuckDB).
Larger tables (HTML entities, accent folding, stopwords) are derived at
import time from a rule or from a public source that ships with Python, or
read from package data (stopwords).
"""

from __future__ import annotations

import functools
import html
import html.entities
import unicodedata
from importlib import resources

# ---------------------------------------------------------------------------
# FIXED VALUES: these must equal the original pipeline's values for equal
# results. Stated verbatim, in their original order.
# ---------------------------------------------------------------------------

# Relevance grades, in domain order; the last two are "relevant".
GRADES = [
    "0 - não é decisão judicial",
    "1 - não tem relação com a LGPD",
    "2 - apenas menciona a LGPD",
    "3 - debate incidental sobre a LGPD",
    "4 - a LGPD é a questão central do caso",
]
RELEVANT_GRADES = ["3 - debate incidental sobre a LGPD", "4 - a LGPD é a questão central do caso"]

# String labels of the labelled-line format.
LABEL_POSITIVE = "__label__positive"
LABEL_NEGATIVE = "__label__negative"

# Decision id from a grade URL: characters stripped from both ends (a set,
# not a prefix), the full-text marker and the separator that precedes the id.
URL_STRIP_CHARS = "https://www.jusbrasil.com.br/jurisprudencia/"
FULLTEXT_MARKER = "inteiro-teor"
FULLTEXT_SPLIT = "/inteiro-teor-"

# Link enrichment: links whose host contains this domain contribute terms.
LINK_DOMAIN = "jusbrasil.com.br"

# ASCII punctuation replaced by a space (28 characters).
PUNCTUATION = "/.!$%^&#*+'\"()-,:;<=>?@[]{}|"

# Party lines: each term, then each plural, deleted up to a closing </p>;
# the same list again up to </tr>; then RELATORA up to </p>, twice.
PARTY_TERMS = ["RECORRENTE", "RECORRIDO", "AGRAVANTE", "AGRAVADO", "EMBARGANTE", "EMBARGADO",
               "SUSCITANTE", "SUSCITADO", "RELATOR", "ADVOGADO"]
PARTY_TERMS_PLURAL = ["RECORRENTES", "RECORRIDOS", "AGRAVANTES", "AGRAVADOS", "EMBARGANTES",
                      "EMBARGADOS", "SUSCITANTES", "SUSCITADOS", "RELATORES", "ADVOGADOS"]
PARTY_CLOSINGS = ["</p>", "</tr>"]
PARTY_TAIL = [("RELATORA", "</p>"), ("RELATORA", "</p>")]

# Stopword extension: state names, then justice names (duplicates and
# multi-word entries are kept as given; multi-word ones never match a token).
STOPWORDS_STATES = ["amazonas", "roraima", "amapá", "pará", "tocatins", "rondônia", "acre", "maranhão",
                    "piauí", "ceará", "rio grande do norte", "pernambuco", "paraíba", "sergipe",
                    "alagoas", "bahia", "mato grosso", "mato grosso do sul", "goiás", "são paulo",
                    "rio de janeiro", "espírito santo", "minas gerais", "paraná", "rio grande do sul",
                    "santa catarina", "rio grande sul", "rio grande", "sao paulo", "rio", "sp", "rondonia",
                    "maranhao", "piaui", "ceara", "paraiba", "goias", "espirito santo", "parana", "catarina"]
STOPWORDS_NAMES = ["celsodemello", "marcoaurélio", "carlosbritto", "ricardolewandowski", "joaquimbarbosa",
                   "ellengracie", "gilmarmendes", "carlosbritto", "cezarpeluso", "nelsonjobim",
                   "ricardolewandowski", "octaviogallotti", "sepúlvedapertence", "moreiraalves",
                   "néridasilveira", "carlosvelloso", "marcoaurelio", "sydneysanches", "sepulvedapertence",
                   "ilmargalvão", "paulobrossard", "celsodemello", "moreiraalves", "octaviogallotti",
                   "mauríciocorrêa", "fux", "barroso", "roberto barroso", "rosa weber", "weber",
                   "robertobarroso", "rosaweber", "alexandredemoraes", "alexandre de moraes", "moraes",
                   "joaquim barbosa", "barbosa", "celso de mello", "mello", "ricardo lewandowski",
                   "lewandowski", "gilmar mendes", "mendes", "luizfux", "luiz fux", "edson fachin",
                   "edsonfachin", "fachin", "celso", "joaquim", "gilmar", "rosa", "roberto",
                   "diastoffoli", "toffoli", "alexandre"]

# Hand features: law number, acronym, full law title (word runs around each).
LAW_CORE = "13.?709"
TERM_CORE = "LGPD"
PHRASE_CORE = "LEI GERAL DE PROTE[ÇC][ÃA]O DE DADO"

# Mask used for person names.
NAME_MASK = "NOME"

# Sequence tokeniser defaults (public defaults of the Keras text tokenizer):
# characters turned into a space, then lowercase, split on a space.
SEQ_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
SEQ_MAXLEN = 2000

# Header names of the grade survey export.
URL_HEADER = "Url:"
GRADE_HEADER = "Pertinência do debate sobre a LGPD:"
BLOG_HEADER = "Decisão merece artigo ou texto no blog:"

# Document vectors: size, window, least count, epochs.
DOC_VECTOR_SIZE = 300
DOC_VECTOR_WINDOW = 15
DOC_VECTOR_MIN_COUNT = 50
DOC_VECTOR_EPOCHS = 40

# Candidate grid of the classifier search.
GRID_LR_PENALTY = ("l1", "l2")
GRID_LR_C = (0.01, 0.1, 1.0)
GRID_SVC_C = (0.1, 1.0)
GRID_GBT_RATE = (0.01, 0.1)
GRID_GBT_DEPTH = (10, None)
GRID_GBT_ITERATIONS = (10, 100)
GRID_LEAFWISE_KIND = ("gbdt", "dart", "goss")
GRID_LEAFWISE_LEAVES = (20, 30)
GRID_LEAFWISE_DEPTH = (None, 10, 20, 25)
GRID_LEAFWISE_RATE = (0.001, 0.1)
GRID_LEAFWISE_ITERATIONS = (10, 100)

# Smoothed-metric epsilon (public default of the Keras backend).
EPSILON = 1e-7

# ---------------------------------------------------------------------------
# Regex dialect helpers
# ---------------------------------------------------------------------------

# Python's \w as an explicit class (Java and RE2 alike).
WORD = r"[\p{L}\p{N}_]"
# Python str.isspace() as a class (Java and RE2 alike).
WS_CLASS = r"[\t\n\x0b\f\r\x1c-\x1f \x85\p{Z}]"
WS_RUN = WS_CLASS + "+"

# Token patterns of the vocabulary step, by preset name.
# name -> (python pattern it stands for, Java pattern, RE2 pattern)
TOKEN_PATTERNS = {
    "letter_word": (r"[a-zA-Z]\w*", r"[a-zA-Z]" + WORD + "*", r"[a-zA-Z]" + WORD + "*"),
    "letters_only": (r"\b[a-zA-Z]{2,}\b", "(?<!" + WORD + r")[a-zA-Z]{2,}(?!" + WORD + ")", None),
    "word2": (r"(?u)\b\w\w+\b", WORD + "{2,}", WORD + "{2,}"),
}

# URL split: 1 scheme, 2 netloc, 3 path (query and fragment dropped).
URL_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"

# HTML markup removed by the text extractor: comments, script/style/template
# blocks, doctype, tags (quoted attribute values may hold '>').
# Possessive loops keep Java's matcher iterative on huge tags.
MARKUP_JAVA = (r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>|<!DOCTYPE[^>]*>"
               r"|</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
MARKUP_RE2 = (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
              r"|<template\b.*?</template\s*>|<!DOCTYPE[^>]*>"
              r"|</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
# Comments and skipped blocks only (anchors are looked for in what remains).
HIDDEN_JAVA = r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>"
HIDDEN_RE2 = (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
              r"|<template\b.*?</template\s*>")
ANCHOR_JAVA = r"(?is)<a\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
ANCHOR_RE2 = r"(?is)<a\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"

# Character references as the standard HTML text decoder finds them.
CHARREF = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;\x00\x01]{1,32};?)"


@functools.lru_cache(maxsize=None)
def html_named_entities() -> dict[str, str]:
    """All HTML5 named references (with and without ';'), from the stdlib."""
    return dict(html.entities.html5)


@functools.lru_cache(maxsize=None)
def html_legacy_entities() -> dict[str, str]:
    """Names that also decode without ';' (longest-prefix rule)."""
    return {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}


@functools.lru_cache(maxsize=None)
def invalid_charrefs() -> dict[int, str]:
    """Numeric references replaced per the HTML standard (stdlib table)."""
    return dict(html._invalid_charrefs)  # noqa: SLF001


@functools.lru_cache(maxsize=None)
def invalid_codepoints() -> list[int]:
    return sorted(html._invalid_codepoints)  # noqa: SLF001


@functools.lru_cache(maxsize=None)
def accent_fold_table() -> tuple[str, str]:
    """(from, to) strings for translate(): every code point whose canonical
    decomposition keeps exactly one ASCII character maps to it."""
    src, dst = [], []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        folded = unicodedata.normalize("NFD", ch).encode("ascii", "ignore").decode("ascii")
        if folded:
            if len(folded) != 1:
                raise AssertionError(f"U+{cp:04X} folds to {folded!r}")
            src.append(ch)
            dst.append(folded)
    return "".join(src), "".join(dst)


@functools.lru_cache(maxsize=None)
def spark_stopwords(language: str = "portuguese") -> list[str]:
    """Apache Spark's default stopword list of a language, shipped as package
    data (Apache License 2.0; a test holds it against
    StopWordsRemover.loadDefaultStopWords)."""
    text = resources.files("lexprep").joinpath("data", f"stopwords_{language}.txt").read_text(encoding="utf-8")
    return [w for w in text.split("\n") if w]


def clean_stopwords(language: str = "portuguese", extend: bool = True) -> list[str]:
    words = list(spark_stopwords(language))
    if extend:
        words += STOPWORDS_STATES + STOPWORDS_NAMES
    seen, out = set(), []
    for w in words:
        if w not in seen:
            seen.add(w)
            out.append(w)
    return out


def party_rules() -> list[tuple[str, str]]:
    """The 42 ordered (term, closing) deletions."""
    rules = [(t, c) for c in PARTY_CLOSINGS for t in PARTY_TERMS + PARTY_TERMS_PLURAL]
    return rules + list(PARTY_TAIL)
