"""Benchmark decontamination with training suffix arrays.

The words of the training texts of a task are taken a few megabytes at a
time: such a shard gets a suffix array over its words, each test suffix is
found in it by binary search, and the range it comes back with holds every
place of the shard where the window stands. No training text is shuffled.

The test set is stated by the caller. It is read in blocks of a fixed size
(``block_bytes``), one pass over the training texts for each block, so what
is broadcast has a bound that does not grow with either table. Windows are
found by 64-bit word hashes.

Null and empty texts have no words. A null item id stands as an empty one.
Repeated rows are judged one by one; rows of the test set with one id are
one item.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexprep.llm import arrow as A
from lexprep.llm.tables import quoted

WINDOW = 13
BLOCK_BYTES = 8 << 20

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()),
                      T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType())])
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("from_word", T.LongType()),
                                                     T.StructField("to_word", T.LongType())]))),
    T.StructField("matches", T.ArrayType(MATCH)),
])


class TestSuffixes:
    """The test suffixes of one block: windows as rows of word numbers, each with the items it starts in."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        col = pa.array([t or "" for _, t in items], pa.large_string())
        data, offsets = A.text_buffer(col)
        _, _, h, bounds = A.words(data, offsets, A.ALNUM)
        self.vocab = np.unique(h)
        self.bits = max(1, int(len(self.vocab) + 1).bit_length())
        self.window = window
        ids = np.searchsorted(self.vocab, h) + 1
        ids = np.concatenate([ids, np.zeros(window, ids.dtype)])
        at, item, length = [], [], []
        for i in range(len(items)):
            n = int(bounds[i + 1] - bounds[i])
            if n:
                k = max(1, n - window + 1)
                at.append(np.arange(bounds[i], bounds[i] + k))
                item.append(np.full(k, i))
                length.append(np.full(k, min(n, window)))
        self.names = [a for a, _ in items]
        at, item, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, item, length))
        rows = ids[at[:, None] + np.arange(window)]
        rows[np.arange(window) >= length[:, None]] = 0
        word = at - bounds[item] if len(at) else at
        # one search for windows that several items share
        self.rows, back = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, at)
        back = np.asarray(back).reshape(-1)
        order = np.lexsort((word, item, back))
        self.item, self.word = item[order], word[order]
        self.first = np.searchsorted(back[order], np.arange(len(self.rows) + 1))
        self.length = (self.rows > 0).sum(axis=1)
        self.least = int(self.length.min()) if len(self.rows) else window
        self.low = self.lanes(self.rows)
        high = self.rows.copy()
        high[high == 0] = (1 << self.bits) - 1
        self.high = self.lanes(high)

    def lanes(self, rows: np.ndarray) -> list[np.ndarray]:
        """Rows of word numbers packed into as few 64-bit columns as hold them, most significant first."""
        per = 64 // self.bits
        out = []
        for k in range(0, self.window, per):
            lane = np.zeros(len(rows), np.uint64)
            for j in range(k, min(k + per, self.window)):
                lane = (lane << np.uint64(self.bits)) | rows[:, j].astype(np.uint64)
            out.append(lane)
        return out


def suffix_array(ids: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array over the words of a shard, to the depth of a window, and its sorted keys.

    A suffix that meets a word of no test item before the shortest window ends equals no test suffix; it is left out."""
    stops = np.flatnonzero(ids == 0)
    run = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(len(ids))
    at = np.flatnonzero(run >= test.least)
    padded = np.concatenate([ids, np.zeros(test.window, ids.dtype)])
    per = 64 // test.bits
    lanes = []
    for k in range(0, test.window, per):
        lane = np.zeros(len(at), np.uint64)
        for j in range(k, min(k + per, test.window)):
            lane = (lane << np.uint64(test.bits)) | padded[at + j].astype(np.uint64)
        lanes.append(lane)
    order = np.lexsort(lanes[::-1])
    return at[order], [x[order] for x in lanes]


def binary_search(keys: list[np.ndarray], query: list[np.ndarray], right: bool) -> np.ndarray:
    """For all queries at once: how many sorted keys are below (or, if right, not above) each."""
    n, q = len(keys[0]), len(query[0])
    lo, hi = np.zeros(q, np.int64), np.full(q, n, np.int64)
    for _ in range(n.bit_length()):
        open_ = lo < hi
        mid = np.minimum((lo + hi) >> 1, max(n - 1, 0))
        less, same = np.zeros(q, bool), np.ones(q, bool)
        for key, want in zip(keys, query):
            got = key[mid]
            less |= same & (got < want)
            same &= got == want
        go = (less | same if right else less) & open_
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)
    return lo


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first[row] + 0 .. count[row]-1) for each row."""
    row = np.repeat(np.arange(len(first)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def search_shard(data: np.ndarray, offsets: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, list, list]:
    """Word counts, hit spans and longest matches of the texts of one shard."""
    _, _, h, bounds = A.words(data, offsets, A.ALNUM)
    n_docs = len(offsets) - 1
    n_words = np.diff(bounds)
    spans, matches = [[] for _ in range(n_docs)], [[] for _ in range(n_docs)]
    if not len(h) or not len(test.rows):
        return n_words, spans, matches
    k = np.minimum(np.searchsorted(test.vocab, h), len(test.vocab) - 1)
    ids = np.where(test.vocab[k] == h, k + 1, 0)
    # a stop after each text, so that no suffix runs on into the next one
    base = bounds + np.arange(n_docs + 1)
    own = np.zeros(len(ids) + n_docs, ids.dtype)
    own[np.arange(len(ids)) + np.repeat(np.arange(n_docs), n_words)] = ids
    at, keys = suffix_array(own, test)
    if not len(at):
        return n_words, spans, matches
    lo, hi = binary_search(keys, test.low, False), binary_search(keys, test.high, True)
    window, place = _expand(lo, hi - lo)
    if not len(window):
        return n_words, spans, matches
    pos = at[place]
    # words inside any occurrence, as maximal spans (the stops part the texts)
    cover = np.zeros(len(own) + 1, np.int64)
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + test.length[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for d, s, e in zip(np.searchsorted(base, a, "right") - 1, a, b):
        spans[d].append((int(s - base[d]), int(e - base[d])))
    # matches of a text and an item that follow each other in both are one longer match
    row, use = _expand(test.first[window], test.first[window + 1] - test.first[window])
    p, item, word = pos[row], test.item[use], test.word[use]
    doc = np.searchsorted(base, p, "right") - 1
    order = np.lexsort((p, p - word, item, doc))
    p, item, word, doc, size = p[order], item[order], word[order], doc[order], test.length[window[row]][order]
    new = np.ones(len(p), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (p[1:] != p[:-1] + 1) | (word[1:] != word[:-1] + 1)
    f = np.flatnonzero(new)
    long = np.diff(np.append(f, len(p))) + size[f] - 1
    pick = np.lexsort((p[f], -long, item[f], doc[f]))
    one = np.ones(len(pick), bool)
    one[1:] = (doc[f][pick][1:] != doc[f][pick][:-1]) | (item[f][pick][1:] != item[f][pick][:-1])
    for k in pick[one]:
        d = int(doc[f][k])
        matches[d].append({"item_id": test.names[item[f][k]], "doc_word": int(p[f][k] - base[d]),
                           "item_word": int(word[f][k]), "n_words": int(long[k])})
    return n_words, spans, matches


def find_matches(docs: DataFrame, items: list[tuple[str, str]], name: str, text_col: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """``docs`` and a struct ``name`` (n_words, spans, matches) against one block of test items."""
    handle = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        test = TestSuffixes(handle.value, window)
        pair = pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())])
        match = pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()),
                           ("n_words", pa.int64())])

        def of(col):
            data, offsets = A.text_buffer(col)
            n, spans, matches = [], [], []
            for i, j in A.chunks(offsets):
                got = search_shard(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], test)
                n.append(got[0])
                spans += got[1]
                matches += got[2]
            return {"n_words": pa.array(np.concatenate(n) if n else [], pa.int64()),
                    "spans": pa.array([[{"from_word": a, "to_word": b} for a, b in s] for s in spans], pa.list_(pair)),
                    "matches": pa.array(matches, pa.list_(match))}

        return of

    return A.with_result(docs, text_col, name, FOUND, make)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The test items, block by block: a block holds about ``block_bytes`` of text."""
    rows = (benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield n, sorted((r["item"], r["text"]) for r in rows.where(block == k).toLocalIterator())


def merged_spans(spans):
    """Sorted, disjoint spans of an array of spans."""
    pair = "struct<from_word:bigint,to_word:bigint>"
    empty = F.array().cast(f"array<{pair}>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            last["from_word"].alias("from_word"), F.greatest(last["to_word"], x["to_word"]).alias("to_word"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["to_word"] >= x["from_word"]),
                      joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, step)


def contamination(docs: DataFrame, benchmark: DataFrame, name: str = "contamination", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` and a struct ``name``: n_words, n_hit, spans (hit words), matches (the longest verbatim match of each
    item: where it starts in text and item, and its words), item_ids, contaminated (n_hit > 0 and 20 * n_hit >= n_words).
    """
    name = A.free_name(docs, name)
    parts, n = [], 1
    key, digest = A.free_name(docs, "row_key"), F.sha2(F.coalesce(F.col(quoted(text_col)), F.lit("")), 256)
    s_, m_ = A.free_name(docs, "spans_of_all"), A.free_name(docs, "matches_of_all")
    for n, items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if n == 1:
            parts.append(find_matches(docs, items, name, text_col, window))
        else:
            # equal texts get equal findings, so those of several passes meet by text; only hits are shuffled
            part = find_matches(docs.select(digest.alias(key), quoted(text_col)), items, name, text_col, window)
            parts.append(part.where(F.size(F.col(name)["spans"]) > 0).select(key, name))
    found = reduce(DataFrame.unionByName, parts)
    if n > 1:
        every = found.groupBy(key).agg(F.flatten(F.collect_set(F.col(name)["spans"])).alias(s_),
                                       F.flatten(F.collect_set(F.col(name)["matches"])).alias(m_))
        plain = find_matches(docs, [], name, text_col, window)
        own = plain.withColumn(key, digest).join(every, key, "left")
        found = own.withColumn(name, F.struct(
            F.col(name)["n_words"].alias("n_words"),
            merged_spans(F.coalesce(F.col(s_), F.col(name)["spans"])).alias("spans"),
            F.array_sort(F.coalesce(F.col(m_), F.col(name)["matches"])).alias("matches"),
        )).drop(key, s_, m_)
    x = F.col(name)
    n_hit = F.aggregate(x["spans"], F.lit(0).cast("long"), lambda a, s: a + s["to_word"] - s["from_word"])
    found = found.withColumn(name, x.withField("n_hit", n_hit).withField(
        "item_ids", F.array_sort(F.array_distinct(F.transform(x["matches"], lambda m: m["item_id"])))))
    return found.withColumn(name, x.withField(
        "contaminated", (x["n_hit"] > 0) & (x["n_hit"] * 20 >= x["n_words"])))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    name = A.free_name(docs, "contamination")
    return contamination(docs, benchmark, name, **options).where(~F.col(name)["contaminated"]).drop(name)
