"""String operators against their definitions in plain Python."""

import time
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import one_col
from lexprep import constants as C
from lexprep.functions import text as T

SPECIAL = [" ", "\u0085", "\r", "\u0130", "\u00b2", "\u00e9", "\u0301", "\x1c", "\u00a0", "\u00df", "\u01c5", ""]


def _col(spark, values, expr):
    return [r[0] for r in one_col(spark, values).select(expr(F.col("t"))).collect()]


def folded(text):
    """Each character's base letter, by its canonical decomposition in unicodedata; other non-ASCII goes."""
    out = []
    for ch in text:
        while unicodedata.decomposition(ch) and not unicodedata.decomposition(ch).startswith("<"):
            ch = chr(int(unicodedata.decomposition(ch).split()[0], 16))
        out.append(ch if ord(ch) < 128 else "")
    return "".join(out)


def cleaned(text, stop):
    """Character by character: punctuation parts words, short words and stopwords go."""
    parted = "".join(" " if ch in C.PUNCTUATION else ch for ch in text).lower()
    words, word = [], ""
    for ch in parted + " ":
        if not ch.isspace():
            word += ch
        elif word:
            words.append(word)
            word = ""
    return " ".join(w for w in words if len(w) > 1 and w not in stop)


def test_punctuation_set_matches_python(spark):
    probe = "".join(chr(i) for i in range(32, 127)) + "¿¡«»“”_\\~`"
    assert _col(spark, [probe], T.remove_punctuation) == ["".join(" " if ch in C.PUNCTUATION else ch for ch in probe)]
    assert len(C.PUNCTUATION) == 28


text_strategy = st.text(alphabet=st.sampled_from(list("aAb ,.;-_\t\nxyz!?'\"") + [c for c in SPECIAL if c]), max_size=60)


@settings(max_examples=30, deadline=None)
@given(st.lists(text_strategy, min_size=1, max_size=8))
def test_clean_plain_text_matches_python(spark, texts):
    stop = C.clean_stopwords()
    got = _col(spark, texts, lambda c: T.clean_plain_text(c, stop))
    assert got == [cleaned(t, set(stop)) for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.lists(text_strategy, min_size=1, max_size=8))
def test_strip_accents_matches_python(spark, texts):
    got = _col(spark, texts, T.strip_accents)
    assert got == [folded(" ".join(t.split())) for t in texts]


def test_strip_tags_single_line(spark):
    got = _col(spark, ["a<b>c</b>d", "x<p\nq>y"], T.strip_tags)
    assert got == ["a c d", "x<p\nq>y"]


def test_remove_parties_golden(spark):
    cases = {
        "<p>RECORRENTE : FULANO</p>": "<p></p>",
        "AGRAVANTE RECORRENTE</p> z</p>": "</p>",
        "RECORRENTE</p> a </p>": "</p>",
        "RELATOR\nX</p>": "RELATOR\nX</p>",
        "nada aqui</p>": "nada aqui</p>",
    }
    assert _col(spark, list(cases), T.remove_parties) == list(cases.values())


def test_mask_and_remove_names(spark):
    df = spark.createDataFrame([("Ana foi. Anabela viu Ana", ["Ana", "Rui"])], "t string, e array<string>")
    row = df.select(T.mask_names("t", "e").alias("m"), T.remove_names("t", "e").alias("r")).first()
    assert row.m == "NOME foi. NOMEbela viu NOME"
    assert row.r == " foi. bela viu "


def test_hand_feature_counts_golden(spark):
    law = "Lei 13.709/2018 e 13709 e 13 709 x13-709y 139709 lei13.7099"
    title = "lei geral de proteção de dados; Lei Geral de Protecao de Dados"
    df = one_col(spark, [law, title, "LGPD lgpd xLGPDy", ""])
    rows = df.select(T.law_count("t").alias("l"), T.term_count("t").alias("g"), T.phrase_count("t").alias("p")).collect()
    assert rows[0].l == 6
    assert rows[1].p == 2
    assert rows[2].g == 3
    assert (rows[3].l, rows[3].g, rows[3].p) == (0, 0, 0)


def test_hand_counts_golden_lines(spark):
    golden = {
        "a LGPD b lgpd": (0, 2, 0),
        "13.709 e 13x709 e 13\n709": (2, 0, 0),
        "Lei Geral de Proteção de Dados pessoais": (0, 0, 1),
        "ção": (0, 0, 0),
        "x13.709y13709": (1, 0, 0),
    }
    df = one_col(spark, list(golden))
    got = df.select(T.law_count("t"), T.term_count("t"), T.phrase_count("t")).collect()
    assert [tuple(r) for r in got] == list(golden.values())


def test_long_documents_take_linear_time(spark):
    run, mentions = "LGPD " + "a" * 80_000, "RECORRENTE x " * 4000
    for text, fn in ((run, T.law_count), (run, T.term_count), (run + " dado 709", T.phrase_count), (run + " 709", T.law_count),
                     (mentions, T.remove_parties), ("</p>" + mentions, T.remove_parties)):
        df = one_col(spark, [text]).select(fn(F.col("t")).alias("x"))
        df.collect()
        t0 = time.perf_counter()
        df.collect()
        assert time.perf_counter() - t0 < 1, fn


def test_single_space_split_keeps_empties(spark):
    assert _col(spark, ["a  b "], T.single_space_split) == [["a", "", "b", ""]]
