"""Quotient filters are lossless; phrases equal a plain count of all n-grams."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from lexprep.llm import collocations as C
from lexprep.llm import quotient_filter as Q


@pytest.mark.parametrize("bits,part_bits", [(2, 0), (2, 3), (7, 5), (16, 4), (21, 9), (22, 6), (32, 12), (40, 20)])
def test_permutation_and_bytes_lose_nothing(bits, part_bits):
    rng = np.random.default_rng(bits)
    layout = Q.Layout(bits, part_bits)
    keys = [np.concatenate([rng.integers(0, 1 << bits, 5000), [0, (1 << bits) - 1, 1, 0]]) for _ in range(3)]
    x, y = layout.permute(*keys)
    assert all((a == b).all() for a, b in zip(layout.restore(x, y), keys))
    want = Counter(zip(*(k.tolist() for k in keys)))
    f = Q.merged(layout, x, y)
    assert dict(zip(zip(*(k.tolist() for k in layout.restore(f.x, f.y))), f.n.tolist())) == want
    f.n[:] = rng.choice([1, 2, 254, 255, 256, 10 ** 12], len(f))
    part, back = layout.part(f.x), []
    assert (np.diff(part) >= 0).all()
    for p in np.unique(part):
        a, b = np.searchsorted(part, p), np.searchsorted(part, p, "right")
        back.append(Q.unpack(layout, int(p), Q.pack(layout, f.slice(a, b))))
    for v in ("x", "y", "n"):
        assert (np.concatenate([getattr(g, v) for g in back]) == getattr(f, v)).all()


def test_empty_filter():
    layout = Q.Layout(8, 2)
    none = np.zeros(0, np.int64)
    f = Q.merged(layout, *layout.permute(none, none, none))
    assert len(f) == 0 and len(Q.unpack(layout, 1, Q.pack(layout, f))) == 0 and len(Q.merge(layout, [f, f])) == 0


def test_merging_shards_adds_counts():
    rng = np.random.default_rng(3)
    for bits in (10, 30):
        layout, want, shards = Q.Layout(bits, 3), Counter(), []
        for _ in range(6):
            keys = [rng.integers(0, 12, 4000) for _ in range(3)]
            want.update(zip(*(k.tolist() for k in keys)))
            shards.append(Q.merged(layout, *layout.permute(*keys)))
        f = Q.merge(layout, shards)
        assert dict(zip(zip(*(k.tolist() for k in layout.restore(f.x, f.y))), f.n.tolist())) == want


def test_a_frequent_key_takes_one_entry():
    layout = Q.Layout(20, 4)
    same = [np.full(1_000_000, v) for v in (5, 6, 7)]
    f = Q.merged(layout, *layout.permute(*same))
    assert len(f) == 1 and f.n[0] == 1_000_000 and len(Q.pack(layout, f)) < 64


def brute(rows, min_count, top, absorbed=50):
    """All n-grams counted in a dictionary, scores as fractions."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= min_count}
    for g, a in candidates.items():
        lang, w = g[0], g[1:]
        if any(h[0] == lang and len(h) > len(g) and 100 * b >= absorbed * a and any(h[i:i + len(w)] == w for i in range(1, len(h)))
               for h, b in candidates.items()):
            continue
        cuts = [(floor(Fraction(1000000 * a * a, f[lang, *w[:k]] * f[lang, *w[k:]])), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], total[lang], score))
    got = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        got += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:top])]
    return sorted(got)


def _docs(spark, rows):
    return spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, n int, `w.1` string")


def _random(seed, n, words):
    rng = random.Random(seed)
    return [(rng.choice(["en", "en", "en", "fr", None, "und"]),
             "".join(rng.choices(words, k=rng.randint(0, 80)))) for _ in range(n)]


WORDS = ["New York ", "new  york\t", "of the ", "the ", "a, ", "b. ", "c\n", "é ", "É ", "no break ", "x;y ", "日本 ", "\x0b", "a ", "a a "]


def test_phrases_equal_brute_force(spark):
    rows = _random(5, 300, WORDS) + [(None, None), ("en", ""), ("de", "  ..,"), ("xx", "only words once here")] + [("en", "hot spot now " * 4000)]
    got = C.phrases(_docs(spark, rows).repartition(3), C.Settings(min_count=3, top=40))
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 40)


def test_small_blocks_parts_and_ranks_change_nothing(spark, monkeypatch):
    rows = _random(6, 200, WORDS)
    want = brute(rows, 2, 15)
    monkeypatch.setattr(C, "RANK_ROWS", 10)
    monkeypatch.setattr(C, "PART_ENTRIES", 16)
    monkeypatch.setattr(C, "ID_BUCKET", 3)
    got = C.phrases(_docs(spark, rows).repartition(5), C.Settings(min_count=2, top=15))
    assert sorted(map(tuple, got.collect())) == want


def test_score_is_exact_past_64_bits(spark):
    a, left, right = 9_007_199_254_740, 9_007_199_254_741, 9_007_199_254_743
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    got = row.select(C.cut_score(C.F.col("a"), C.F.col("l"), C.F.col("r"))).first()[0]
    assert got == 1000000 * a * a // (left * right)


def test_empty_table_and_texts_without_phrases(spark):
    assert C.phrases(_docs(spark, [])).count() == 0
    assert C.phrases(_docs(spark, [("en", "a b c"), (None, None)])).count() == 0


def test_repeated_rows_count_each_time(spark):
    rows = [("en", "one two three")] * 12
    got = C.phrases(_docs(spark, rows))
    assert [tuple(r) for r in got.collect()] == [("en", 1, "one two three", 12, 12, 12, 36, 1000000)]
