"""Operators on texts: brute force on small tables, and the odd cases each must stand."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lexprep.llm import brown_lm, decontaminate, license_scan, quality, simhash, suffix_dedup, toxicity

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"
# columns that clash with names the operators use inside
SCHEMA = "doc_id long, text string, score string, x int, row_key string, h1 string, rid string, spans string"


def alnum(text):
    return re.findall(ALNUM, (text or "").translate(ASCII))


def spaced(text):
    return re.findall(SPACED, (text or "").translate(ASCII))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "r", "h", "q", "p") for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.expovariate(0.02)), vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    base = prose(rng, 60)
    return [(1, base), (2, base), (2, base), (3, None), (None, None), (None, "null id " + prose(rng, 20)), (4, ""),
            (5, "   \n\t"), (6, "ÀÉ ünïcode " + prose(rng, 40)), (7, prose(rng, 60000)), (8, "x"), (9, "a b"),
            (10, base + " tail of another kind " + prose(rng, 30)), (11, "!" * 500), (12, "a" * 700)]


# -- decontamination ------------------------------------------------------------------------------------------

def windows(text):
    w = alnum(text)
    if not w:
        return []
    return [tuple(w[k:k + 13]) for k in range(max(1, len(w) - 12))] if len(w) >= 13 else [tuple(w)]


def brute_contamination(rows, items):
    out = []
    for i, text in rows:
        w = alnum(text)
        hit, ids = set(), set()
        for item, t in items:
            for win in set(windows(t)):
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k:k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        ids.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_contamination_matches_brute_force(spark, odd_rows, block_bytes):
    rng = random.Random(7)
    long_item, item = prose(rng, 30), prose(rng, 13)
    items = [(100, long_item), (101, item), (102, item), (103, "short ITEM here"), (104, None), (105, ""), (None, "no id at all"),
             (103, "second text of one id " + prose(rng, 14))]
    rows = odd_rows + [(20, "before " + long_item + " after"), (21, long_item[:len(long_item) // 2]), (22, "a Short item, HERE!"),
                       (23, item + " " + item), (24, "no id at all"), (25, prose(rng, 400) + " " + item)]
    rows = [(i, t) for i, t in rows if i != 7]
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, extra string")
    got = decontaminate.contamination(table(spark, rows), bench, "x", block_bytes=block_bytes)
    assert set(got.columns) - {"x_"} >= set(SCHEMA.replace(",", "").split()[::2])
    out = sorted([(r["doc_id"], r["x_"]["n_words"], r["x_"]["n_hit"], r["x_"]["item_ids"], r["x_"]["contaminated"]) for r in got.collect()], key=repr)
    assert out == brute_contamination(rows, items)


def test_longest_match_and_its_place(spark):
    item = " ".join(f"t{k}" for k in range(40))
    docs = table(spark, [(1, "a b c " + " ".join(f"t{k}" for k in range(5, 30)) + " z")])
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    m = decontaminate.contamination(docs, bench, "m").first()["m"]["matches"]
    assert [tuple(x) for x in m] == [("9", 3, 5, 25)]


def test_contamination_of_empty_tables(spark):
    none = table(spark, [])
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    one = table(spark, [(1, "one two three")])
    assert decontaminate.remove_contaminated(one, bench).count() == 0
    assert decontaminate.remove_contaminated(one, bench.limit(0)).columns == one.columns


# -- licences -------------------------------------------------------------------------------------------------

def test_licence_base_phrases_match_brute_force(spark, odd_rows):
    rows = odd_rows + [(30, "MIT License, apache LICENSE mit-license"), (31, "General Public License"), (32, "license mit"),
                       (33, "license " * 300), (34, "é Licensed under CC BY-NC 4.0."),
                       (35, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                            "associated documentation files, the Software, to deal in the Software without restriction")]
    got = {(r["doc_id"], r["text"]): r["x_"] for r in license_scan.scan(table(spark, rows), "x_").collect()}
    for i, text in rows:
        w, spots, labels = alnum(text), [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
            spots += at
            labels |= {label} if at else set()
        r = got[(i, text)]
        assert (r["n_words"], sorted(r["places"]), r["base_labels"]) == (len(w), sorted(spots), sorted(labels))
        assert 0 <= r["score"] <= 1 and set(r["base_labels"]) <= set(r["labels"])
    assert "cc-by-nc" in got[rows[-2]]["labels"] and "mit" in got[rows[-1]]["labels"] and not got[rows[-1]]["base_labels"]
    assert license_scan.scan(table(spark, []), "x_").count() == 0


# -- SimHash --------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = spaced(text)
    if not w:
        return 0
    g = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, limit):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_simhash_matches_brute_force(spark, odd_rows):
    rng = random.Random(3)
    text = prose(rng, 400)
    near = [(40 + k, text.replace(f"w{k}", "changed", 1)) for k in range(30)]
    rows = odd_rows + near
    got = simhash.groups(table(spark, rows)).collect()
    fp = {t: brute_fingerprint(t) for _, t in rows}
    root = brute_groups(set(fp.values()), 2)
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[fp[t]]] = min(least.get(root[fp[t]], i), i)
    want = Counter((i, fp[t], least.get(root[fp[t]])) for i, t in rows)
    assert Counter((r["id"], r["fp"] & (2 ** 64 - 1), r["component_id"]) for r in got) == want
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    out = kept.collect()
    assert Counter(root[fp[r["text"]]] for r in out) == Counter(set(root.values()))
    assert simhash.keep_one(table(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [64, 3])
def test_simhash_links_are_whole(spark, limit):
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(200)}
    centre = rng.getrandbits(64)
    for k in range(150):  # a crowd: most share many buckets
        fps.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = simhash.links(df, bucket_limit=limit)
    edges = [(r["a"] & (2 ** 64 - 1), r["b"] & (2 ** 64 - 1)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = brute_groups(fps, 2)
    assert {(find(a) == find(b)) == (want[a] == want[b]) for a in fps for b in list(fps)[:50]} == {True}


# -- repeated bytes -------------------------------------------------------------------------------------------

def brute_cut(rows, size):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + size] for _, b in raw for k in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k:k + size]] > 1:
                gone[k:k + size] = b"\1" * size
        left = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [256, 1])
def test_repeated_bytes_match_brute_force(spark, odd_rows, group):
    rng = random.Random(13)
    passage, other = prose(rng, 70), prose(rng, 90)
    rows = odd_rows[:9] + odd_rows[10:]
    rows += [(50 + k, prose(rng, rng.randrange(40)) + " " + passage + " " + prose(rng, rng.randrange(40))) for k in range(12)]
    rows += [(70 + k, prose(rng, 20) + other[k * 3:250 + 11 * k] + prose(rng, 10)) for k in range(15)]
    rows += [(90, passage + passage), (91, other[:199]), (92, other[:200]), (93, "é" + other[1:260] + "é"), (94, "ab" * 400)]
    got = suffix_dedup.without_repeats(table(spark, rows), "cut", group=group, keep_text=True).collect()
    out = sorted([(r["doc_id"], *(r["cut"][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))) for r in got], key=repr)
    assert out == brute_cut(rows, 200)


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    rng = random.Random(17)
    passage = prose(rng, 80)
    rows = [(1, prose(rng, 3000) + passage + prose(rng, 900)), (2, prose(rng, 40) + passage), (3, prose(rng, 2500))]
    monkeypatch.setattr(suffix_dedup.pieces, "__defaults__", (200, 1000))
    import pyarrow as pa

    from lexprep.llm import arrow as A
    data, offsets = A.text_buffer(pa.array([t for _, t in rows]))
    for i, shift, part, offs in suffix_dedup.pieces(data, offsets):
        assert bytes(part) in (rows[i][1].encode() if len(offs) == 2 else bytes(data))
        text, first, count, *_ = suffix_dedup.anchors(part, offs)
        assert count.sum() == sum(max(0, n - 199) for n in offs[1:] - offs[:-1])


def test_cut_repeats_keeps_columns_and_clean_texts(spark):
    rng = random.Random(19)
    p = prose(rng, 80)
    docs = spark.createDataFrame([(1, p, 3), (2, "clean " + prose(rng, 50), 4), (3, "start " + p, 5), (4, None, None)],
                                 "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in suffix_dedup.cut_repeats(docs).collect()}
    assert out[1]["text"] == "" and out[1]["n_chars"] == 0 and out[3]["text"] == "start " and out[3]["n_chars"] == 6
    assert out[2]["text"].startswith("clean") and out[2]["n_chars"] == 4 and out[4]["text"] is None
    assert suffix_dedup.cut_repeats(docs.limit(0)).columns == docs.columns


# -- language model -------------------------------------------------------------------------------------------

def brute_brown(rows, held, core, size, classes, prior):
    """log10 probability of each text, word by word, from the classes of the clustered words: {word: class}."""
    unseen, end = classes, classes + 1
    c = Counter(t for i, x in rows if not held(i) for t in spaced(x))
    train = [spaced(x) for i, x in rows if not held(i)]
    seen = {}  # of each word: Counter of (side, class beside it)
    for ws in train:
        marks = [end, *(core.get(w, unseen) for w in ws), end]
        for k, w in enumerate(ws):
            seen.setdefault(w, Counter()).update([(0, marks[k]), (1, marks[k + 2])])
    of = {k: sum((seen[w] for w in core if core[w] == k), Counter()) for k in set(core.values())}
    part = {k: sum(size[w] for w in core if core[w] == k) / sum(size.values()) for k in of}

    def fit(w, k):
        total = [sum(n for (s, _), n in of[k].items() if s == side) + 0.5 * (classes + 2) for side in (0, 1)]
        return math.log(part[k]) + sum(n * math.log((of[k][x] + 0.5) / total[x[0]]) for x, n in seen[w].items())

    cls = {w: core[w] if w in core else max(sorted(of), key=lambda k: round(fit(w, k), 9)) for w in c}
    g, own = Counter(), Counter(cls[t] for ws in train for t in ws)
    for ws in train:
        prev, prev_once = end, False
        for w in [*ws, None]:
            k, once = (end, False) if w is None else (cls[w], c[w] == 1)
            g[prev, k] += 1
            g[prev, unseen] += once
            g[unseen, k] += prev_once
            g[unseen, unseen] += once and prev_once
            prev, prev_once = k, once
    used = [k for k in range(classes + 2) if k >= classes or own[k]]
    share = {k: sum(g[a, k] for a in range(classes + 2)) + 1 for k in used}
    share = {k: x / sum(share.values()) for k, x in share.items()}
    out = []
    for i, x in rows:
        total, prev = 0.0, end
        for w in [*spaced(x), None]:
            k = end if w is None else cls.get(w, unseen)
            total += math.log10((g[prev, k] + prior * share[k]) / (sum(g[prev, b] for b in range(classes + 2)) + prior))
            total += 0 if w is None else math.log10(c[w] / own[k]) if w in c else -math.log10(len(c) + 1)
            prev = k
        out.append((repr(i), total))
    return sorted(out), cls


@pytest.mark.parametrize("lookup", [120, 1 << 18])
def test_brown_scores(spark, odd_rows, lookup):
    """Base and model score of each text against plain Python; the size of the lookup changes nothing."""
    rng = random.Random(23)
    rows = odd_rows + [(200 + k, prose(rng, 120)) for k in range(60)]
    rows += [(300, " ".join(f"tail{k} und" for k in range(90))), (301, "tail3 tail4 never und"), (301, "tail3 tail4 never und")]
    small = brown_lm.Settings(lookup=lookup, clustered=30, classes=6)
    docs = table(spark, rows)
    model, got = brown_lm.perplexity(docs, ~brown_lm.held_out(), settings=small)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for i, x in rows if not held(i) for t in [*spaced(x), None])
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), len(spaced(x)) + 1, sum(c[t] > 0 for t in [*spaced(x), None]),
                   round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in [*spaced(x), None]), 6)) for i, x in rows)
    have = got.collect()
    assert sorted((repr(r["id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in have) == want
    assert model.n == n and model.v == v
    # the clustered words by their hashes, all others by rule
    import numpy as np
    import pyarrow as pa

    names = sorted(t for t in c if t is not None)
    h = np.concatenate([h for _, _, h, _ in brown_lm.tokens(pa.array(names))])
    core = model.lexicon.top.first(model.lexicon.core)
    clustered = {w: int(model.lexicon.cls[k]) for w, k in zip(names, core.find(h)) if k < model.lexicon.core}
    assert 0 < len(clustered) <= 30 and min(c[w] for w in clustered) >= max(c[w] for w in names if w not in clustered)
    brute, cls = brute_brown(rows, held, clustered, {w: c[w] for w in clustered}, 6, small.prior)
    table_of = {r["h"]: (r["cls"], r["c"]) for r in model.lexicon.words.collect()}
    assert table_of == {int(k): (cls[w], c[w]) for w, k in zip(names, h.view(np.int64)) if w not in clustered}
    scores = sorted((repr(r["id"]), r["score"]) for r in have)
    assert all(i == j and math.isclose(x, y, rel_tol=1e-9) for (i, x), (j, y) in zip(scores, brute, strict=True))
    # a distribution: where each class leads sums to one, and so does what each class emits
    assert abs((10.0 ** model.step).sum(axis=1) - 1).max() < 1e-9
    own = Counter()
    for w in names:
        own[cls[w]] += c[w]
    assert all(abs(own[k] / 10 ** model.own[k] - 1) < 1e-9 for k in own)


def test_brown_without_training_rows(spark):
    docs = table(spark, [(1, "a b"), (2, None)])
    _, got = brown_lm.perplexity(docs, F.lit(False))
    assert sorted((r["n_tokens"], r["n_known"], r["base_score"]) for r in got.collect()) == [(1, 0, 0.0), (3, 0, 0.0)]
    assert brown_lm.perplexity(table(spark, []), F.lit(True))[1].count() == 0


def test_exchange_finds_the_two_halves():
    import numpy as np

    rng = np.random.default_rng(1)
    pairs = np.zeros((12, 12))
    pairs[:6, 6:] = rng.integers(50, 90, (6, 6))
    pairs[6:, :6] = rng.integers(50, 90, (6, 6))
    order = rng.permutation(12)
    cls = brown_lm.exchange(pairs[np.ix_(order, order)], 2, 10)
    assert len(set(cls[order < 6])) == 1 and len(set(cls[order >= 6])) == 1 and len(set(cls)) == 2


# -- classifiers ----------------------------------------------------------------------------------------------

def labelled(spark, make, n=240, seed=29):
    rng = random.Random(seed)
    rows = [(k, *make(rng, k)) for k in range(n)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (10 ** 9, 1, 1), (0, None, None)],
                                   "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_quality_on_held_out_rows(spark):
    def make(rng, k):
        good = rng.random() < 0.6
        text = prose(rng, 80) + ("." if good else " || " + "SPAM!! " * rng.randrange(1, 9) + prose(rng, 10).upper())
        return text, int(good)

    rows, docs, labels = labelled(spark, make)
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["r"]["score"] for r in quality.with_score(docs, model, "r").collect()}
    test = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(test) >= 0.9 * len(test)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "word " * 200000), (3, "word " * 200000)], "doc_id long, text string")
    out = [r["r"]["score"] for r in quality.with_score(odd, model, "r").collect()]
    assert len(out) == 5 and all(0 <= s <= 1 for s in out) and out[0] == out[1] and out[3] == out[4]
    assert quality.keep_good(docs.limit(0), labels).columns == docs.columns
    assert {r["r"]["score"] for r in quality.with_score(docs, quality.fit(docs, labels.limit(0)), "r").collect()} == {0.5}


def test_toxicity_finds_documents_and_sentences(spark):
    def make(rng, k):
        bad = rng.random() < 0.4
        s = [prose(rng, 9) + "." for _ in range(rng.randrange(1, 8))]
        if bad:
            s[rng.randrange(len(s))] = prose(rng, 3) + f" {rng.choice(['badword', 'vileword'])} " + prose(rng, 3) + "!"
        return " ".join(s), int(bad)

    rows, docs, labels = labelled(spark, make, 400)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["r"] for r in toxicity.with_score(docs, model, "r").collect()}
    test = [(got[i]["score"] >= 0.3) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(test) >= 0.95 * len(test)
    for i, text, y in rows:
        for s in got[i]["offending"] if y else []:
            assert re.search("badword|vileword", text.encode()[s["first_byte"]:s["first_byte"] + s["n_bytes"]].decode())
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "badword"), (3, "word " * 200000), (4, "é. badword é!")], "doc_id long, text string")
    out = {r["doc_id"]: r["r"] for r in toxicity.with_score(odd, model, "r").collect()}
    assert out[1]["score"] == out[2]["score"] == 0 and out[None]["score"] > 0.3 and out[4]["offending"][0]["sentence"] == 1
    assert toxicity.remove_toxic(docs.limit(0), labels).columns == docs.columns
    assert toxicity.with_score(docs, toxicity.fit(docs, labels.limit(0)), "r").count() == len(rows)


def test_quality_scores_little_text_at_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lexprep.llm import arrow as A

    col = pa.array(["palavra outra coisa " * 100] * 4000)
    data, offsets = A.text_buffer(col)
    model = quality.Model(np.linspace(-1, 1, 1 << 18).astype(np.float32), 0.1, quality.Settings())
    tracemalloc.start()
    got = quality.score_texts(data, offsets, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # 233 MB in chunks of 4 MB
    alone = quality.score_texts(data[:offsets[1]], offsets[:2], model)
    assert np.allclose(got, alone[0], rtol=0, atol=1e-12)
