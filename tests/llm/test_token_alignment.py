"""Alignment against whole-text encodings: cuts, byte ranges, groups, links and corpus counts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import SF_SMALL
from lexprep.llm import arrow as A
from lexprep.llm import queries as Q
from lexprep.llm import token_alignment as K

ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b   c", "\n x\t y \r\n z ", "é à ü x 　 y  z", "𝄞 é𝄞x ①② ﬁ",
       "▁x", "a ▁b", "ok", "<s> </s> <unk> <0x41> <|endoftext|> it's we'll", "a\u0000b \u0001 c", "日本語の文 と 空白 ",
       "́a é x", "🙂🙂 👩‍👩‍👧 ok", "x" * 5000, "word " * 3000, "\u0085 a  b", "can't 'S 12,345.67 !?", "ß " * 5 + "ß"]


@pytest.fixture(scope="module")
def pair():
    return K.Pair(*K.Files().read())


def brute(pair, text):
    """Whole-text encodings only: byte ranges from decoded bytes, links by comparing all tokens."""
    if not text:
        return None
    want = (" " + text).encode()
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    if b"".join(pair.a_bytes[i] for i in a) != want or b"".join(pair.b_bytes[i] for i in b) != want:
        return None
    ea, eb = np.cumsum([len(pair.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(pair.b_bytes[i]) for i in b]).tolist()
    both, groups, i, j = sorted(set(ea) & set(eb)), [], 0, 0
    for e in both:
        x, y = [], []
        while i < len(a) and ea[i] <= e:
            x.append(a[i])
            i += 1
        while j < len(b) and eb[j] <= e:
            y.append(b[j])
            j += 1
        groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
    links, j = [], 0
    for i, e in enumerate(ea):
        s = ea[i - 1] if i else 0
        while eb[j] <= s:
            j += 1
        k = j
        while k < len(eb) and (eb[k - 1] if k else 0) < e:
            links.append((a[i], b[k]))
            k += 1
    return len(a), len(b), both, ";".join(groups), links


def expected(pair, rows):
    found = [(i, brute(pair, t)) for i, t in rows]
    count = Counter(x for _, g in found if g for x in g[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(i, *((g[0], g[1], len(g[2]), len(g[4]), sum(count[x] == most[x[1]] for x in g[4]), sum(count[x] for x in g[4]),
                   hashlib.sha256(g[3].encode()).hexdigest()) if g else (0, 0, 0, 0, 0, 0, ""))) for i, g in found]


def _texts(seed, n=150):
    rng = random.Random(seed)
    alphabet = list("ab c  \n\t'.,0é") + [" ", " ", "日", "𝄞", "the ", " of", "ç", "<s>", "́", "’s", " ß"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)]


def test_cut_texts_align_like_whole_ones(pair):
    assert pair.cuts
    texts = ODD + _texts(1) + _texts(2)
    data, offsets = A.text_buffer(pa.array(texts, pa.string()))
    block = K.Block(pair, data, offsets)
    n_a, n_b, groups = block.total(block.got.n_a), block.total(block.got.n_b), block.groups()
    for k, t in enumerate(texts):
        g = brute(pair, t)
        assert (int(n_a[k]), int(n_b[k]), groups[k]) == ((g[0], g[1], g[3]) if g else (0, 0, "")), repr(t)


def test_every_cut_comes_after_a_visible_character():
    texts = ["é é", "a b", "  b", " ", "à", " x", "ç "]
    data, offsets = A.text_buffer(pa.array(texts))
    starts, ends, bounds = K.cut(data, offsets)
    raw = data.tobytes()
    got = [[raw[starts[i]:ends[i]].decode() for i in range(bounds[k], bounds[k + 1])] for k in range(len(texts))]
    assert got == [["é", "é"], ["a", "b"], ["  b"], [" "], ["à"], [" x"], ["ç "]]


def _rows(spark, rows):
    return spark.createDataFrame([(i, t, 5, "own") for i, t in rows], "doc_id long, text string, block int, `pairs.n` string")


def test_counts_equal_brute_force_on_odd_rows(spark, pair):
    rows = list(enumerate(ODD)) + [(None, "null id"), (3, "a b"), (3, "a b")] + [(100 + k, t) for k, t in enumerate(_texts(3))]
    got = K.document_counts(K.align(_rows(spark, rows).repartition(3)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(pair, rows), key=str)


def test_groups_and_their_ends(spark, pair):
    rows = list(enumerate(ODD))
    got = K.with_groups(_rows(spark, rows), "block_").collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: r["doc_id"]), rows):
        g = brute(pair, t)
        assert (r["block_"]["groups"], r["block_"]["ends"]) == ((g[3], g[2]) if g else ("", [])), repr(t)
        assert r["block"] == 5 and r["pairs.n"] == "own"


def test_empty_table(spark):
    empty = _rows(spark, [])
    found = K.align(empty)
    assert found.pairs.count() == 0 and K.document_counts(found).count() == 0 and K.with_groups(empty, "g").count() == 0


def test_registered_query_equals_brute_force(spark, pair):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = Q.QUERIES["op12_token_alignment"](spark, SF_SMALL)
    assert got.dtypes == [("doc_id", "bigint"), ("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"),
                          ("n_best", "bigint"), ("count_sum", "bigint"), ("groups_sha256", "string")]
    assert sorted(map(tuple, got.collect())) == sorted(expected(pair, rows))


def test_blocks_are_dealt_over_as_many_tasks(spark):
    """A task that puts the counts back holds few blocks, however many there are."""
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(60)], "doc_id long, text string").repartition(12)
    found = K.align(docs)
    n = found.blocks.count()
    counts = K.document_counts(found)
    assert n >= 12 and counts.rdd.getNumPartitions() == n
    assert counts.count() == 60


def test_a_row_group_is_one_block(spark):
    """Three texts of a block each in one task: a writer, or reader, of the blocks holds one of them at a time."""
    docs = spark.createDataFrame([(i, "word " * (K.BLOCK_BYTES // 4) + str(i)) for i in range(3)], "doc_id long, text string")
    files = K.align(docs.coalesce(1)).blocks.inputFiles()
    groups = [m.row_group(k).num_rows for f in files for m in [pq.read_metadata(f.removeprefix("file://"))]
              for k in range(m.num_row_groups)]
    assert groups == [1, 1, 1]


def test_texts_encoded_at_once_are_few_bytes():
    stretches = [b"x" * 9] * 10_000 + [b"y" * 99_999] * 3
    todo = [[k] for k in range(len(stretches))]
    waves = list(K._waves(todo, stretches))
    assert [ks for w in waves for ks in w] == todo
    assert all(len(w) == 1 or sum(len(stretches[k]) + 1 for ks in w for k in ks) <= K.WAVE_BYTES for w in waves)
    assert [len(w) for w in waves[-3:]] == [1, 1, 1]
