"""Brown class-based bigrams.

Words are put into classes by exchange clustering: one word after another
moves to the class that gains most likelihood of the class bigrams, until
nothing moves. A text's probability is the product, over its tokens, of a
class transition and a word emission; both are smoothed, so every text has
one.

Exchange runs on the bigrams of the ``clustered`` most frequent words (at most
its square, to the driver). Every other word of the training texts, however
rare, then joins the class whose words have the likeliest neighbours for its
own ones: what stands before and after it, by class, is counted in the tasks,
summed for each word by a shuffle and met with the classes' own neighbours
where the sums are. The table of all words (hash, class, count) stays a
DataFrame and grows with the corpus. The ``lookup`` most frequent words are
also sent to the executors, which saves most of a join and changes no result:
all other words of a text are joined with the table.

A word never seen has the class of the unseen. Words that training saw once
tell how likely it is: each counts as an escape to that class from the class
before it, and what follows it as following that class (Witten and Bell). As
many unseen words are supposed as were seen, all equally likely.

Null and empty texts consist of their end alone. Without any training text
every count is zero. Repeated rows count each time; ties between classes go to
the lower number, between words of one count to the lower hash. A very long
text is read in pieces as one row, a byte for each token; an empty table gives
an empty one. Columns other than the id and the text are not read, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexprep.llm import arrow as A
from lexprep.llm import labelled as L
from lexprep.llm.tables import quoted, written

#: entries (word, neighbouring class, count) that a task holds before it passes them on
HELD = 1 << 21
#: in a path, the mark of a word that training saw once
ONCE = 128


@dataclass(frozen=True)
class Settings:
    lookup: int = 1 << 18
    clustered: int = 1024
    classes: int = 64  # at most 126: a path has one byte for each token
    sweeps: int = 8
    prior: float = 20.0  # weight of the class shares in a transition, in observations


def tokens(col: pa.Array):
    """For a few megabytes at a time: row range, word hashes, and where each text's words begin."""
    data, offsets = A.text_buffer(col)
    for i, j in A.chunks(offsets):
        _, _, h, bounds = A.words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], A.NONSPACE)
        yield i, j, h, bounds


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): how often each word stands in column ``text``; summed within the task before the shuffle."""

    def run(batches):
        for b in batches:
            got = [h for _, _, h, _ in tokens(b.column(0))]
            if got:
                h, c = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    return A.map_arrow(texts, run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """The most frequent words: hashes in order, and the rank of each."""

    h: np.ndarray
    rank: np.ndarray
    count: np.ndarray  # by rank

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ranks; the number of words in the table for one that it has not."""
        n = len(self.h)
        if not n:
            return np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(self.h, h), n - 1)
        return np.where(self.h[k] == h, self.rank[k], n)

    def first(self, n: int) -> Words:
        """The n most frequent of them."""
        use = self.rank < n
        return Words(self.h[use], self.rank[use], self.count[:n])


def top_words(counts: DataFrame, n: int) -> Words:
    """The most frequent words, at most ``n``: all whose count lies in the highest bands of a fixed logarithmic scale that
    hold no more than that. Of the words, only these come to the driver, and no task sorts them all."""
    band = F.floor(F.log2("c") * 64)  # at most 64 * 63 bands
    sizes = sorted(((r["band"], r["count"]) for r in counts.groupBy(band.alias("band")).count().collect()), reverse=True)
    least, total = None, 0
    for b, k in sizes:
        if total + k > n:
            break
        least, total = b, total + k
    t = counts.where(band >= least).select("h", "c").toArrow() if total else pa.table({"h": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    h, c = np.asarray(t["h"]).view(np.uint64), np.asarray(t["c"])
    by = np.lexsort((h, -c))
    h, c = h[by], c[by]
    order = np.argsort(h)
    return Words(h[order], order, c)


def with_ends(marks: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """``marks`` of all words with the end of each text put in."""
    n_texts = len(bounds) - 1
    path = np.full(len(marks) + n_texts, end, marks.dtype)
    path[np.arange(len(marks)) + np.repeat(np.arange(n_texts), np.diff(bounds))] = marks
    return path


def neighbours(texts: DataFrame, core: Words) -> DataFrame:
    """(a, b, c): how often b follows a, by rank in ``core``; a word outside it has the rank after the last, the end of a
    text, before its beginning too, the one after that."""
    handle, m = texts.sparkSession.sparkContext.broadcast(core), len(core.count)

    def run(batches):
        for b in batches:
            got = []
            for _, _, h, bounds in tokens(b.column(0)):
                path = with_ends(handle.value.find(h), bounds, m + 1)
                got.append(np.append(m + 1, path[:-1]) * (m + 2) + path)
            if got:
                u, c = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u // (m + 2)), pa.array(u % (m + 2)), pa.array(c.astype(np.int64))], names=["a", "b", "c"])

    return A.map_arrow(texts, run, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


def exchange(pairs: np.ndarray, n_classes: int, sweeps: int) -> np.ndarray:
    """Class of each word from a matrix of bigram counts, by moving one word at a time to its best class."""
    n = len(pairs)
    cls = np.arange(n) % n_classes
    if n <= n_classes:
        return cls
    f = lambda x: x * np.log(np.maximum(x, 1))
    one = np.zeros((n, n_classes))
    one[np.arange(n), cls] = 1
    g = one.T @ pairs @ one
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            own, here = pairs[w, w], cls[w]
            right = np.bincount(cls, pairs[w], n_classes)
            left = np.bincount(cls, pairs[:, w], n_classes)
            right[here] -= own
            left[here] -= own
            g[here] -= right
            g[:, here] -= left
            g[here, here] -= own
            row, col = g.sum(axis=1), g.sum(axis=0)
            d = np.arange(n_classes)
            up, side = f(g + right[None, :]) - f(g), f(g.T + left[None, :]) - f(g.T)
            gain = up.sum(axis=1) - up[d, d] + side.sum(axis=1) - side[d, d]
            gain += f(g[d, d] + right + left + own) - f(g[d, d])
            gain -= f(row + right.sum() + left + own) - f(row) + f(col + left.sum() + right + own) - f(col)
            best = int(np.argmax(gain))
            if gain[best] <= gain[here] + 1e-9:
                best = int(here)
            moved += best != here
            cls[w] = best
            g[best] += right
            g[:, best] += left
            g[best, best] += own
        if not moved:
            break
    return cls


def context_weights(pairs: np.ndarray, cls: np.ndarray, size: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, start): for each class, log probabilities of what stands before (first half of the rows) and after its
    clustered words, and of the class itself; a class without words is out of reach."""
    n = n_classes + 2
    one = np.zeros((len(pairs), n))
    one[np.arange(len(pairs)), np.append(cls, [n_classes, n_classes + 1])] = 1
    g = one.T @ pairs @ one
    before, after = g[:, :n_classes] + 0.5, g[:n_classes].T + 0.5
    both = np.vstack([before / before.sum(axis=0), after / after.sum(axis=0)])
    own = np.bincount(cls, size, n_classes)
    start = np.full(n_classes, -np.inf)
    start[own > 0] = np.log(own[own > 0] / own.sum())
    if not len(cls):
        start[0] = 0.0
    return np.log(both), start


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array: item i holds the bytes of values[at[i]:at[i+1]]."""
    at = at * values.itemsize
    if at[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    raise ValueError("a batch of tokens over two GB")


def contexts(texts: DataFrame, core: Words, cls: np.ndarray, s: Settings) -> DataFrame:
    """(h, seen): neighbours, by class, of each word outside ``core``, as 64-bit numbers (class << 48) + count; classes
    of what stands after it are counted from s.classes + 2. A task passes on few rows for each word, however often."""
    handle, m = texts.sparkSession.sparkContext.broadcast((core, cls)), len(core.count)
    n = s.classes + 2

    def packed(held):
        h, at = np.unique(np.concatenate([x for x, _, _ in held]), return_inverse=True)
        key, at = np.unique(at * (2 * n) + np.concatenate([f for _, f, _ in held]), return_inverse=True)
        c = np.zeros(len(key), np.int64)
        np.add.at(c, at, np.concatenate([c for _, _, c in held]))
        return h[key // (2 * n)], key % (2 * n), c

    def rows(h, f, c):
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), _binary((f << 48) + c, np.append(at, len(h)))], names=["h", "seen"])

    def run(batches):
        core, cls = handle.value
        mark = np.append(cls, s.classes)
        held, size = [], 0
        for b in batches:
            for _, _, h, bounds in tokens(b.column(0)):
                r = core.find(h)
                path = with_ends(mark[r], bounds, s.classes + 1)
                out = np.flatnonzero(r == m)
                if not len(out):
                    continue
                at = out + np.searchsorted(bounds, out, "right") - 1  # place in the path
                left = np.append(s.classes + 1, path)[at]
                held.append(packed([(h[out], left, np.ones(len(out), np.int64)), (h[out], n + path[at + 1], np.ones(len(out), np.int64))]))
                size += len(held[-1][0])
                if size > HELD:
                    held = [packed(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*packed(held))

    return A.map_arrow(texts, run, A.struct(h="long", seen="binary"))


def join_classes(seen: DataFrame, weights: np.ndarray, start: np.ndarray) -> DataFrame:
    """(h, cls, c): the likeliest class of each word by all its neighbours, and its count. A word's rows are read one
    after the other; what a task holds of a word is one sum for each class of neighbours."""
    handle = seen.sparkSession.sparkContext.broadcast((weights, start))
    half = len(weights) // 2

    def run(batches):
        weights, start = handle.value
        last, kept = None, None

        def found(h, x):
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array((x @ weights + start).argmax(axis=1)),
                                               pa.array(x[:, :half].sum(axis=1).astype(np.int64))], names=["h", "cls", "c"])

        for b in batches:
            h = np.asarray(b.column(0))
            if not len(h):
                continue
            data, offsets = A.text_buffer(b.column(1))
            new = np.append(True, h[1:] != h[:-1])
            word = np.cumsum(new) - 1
            v = data.view(np.int64) if data.ctypes.data % 8 == 0 else np.frombuffer(data.tobytes(), np.int64)
            x = np.bincount(np.repeat(word, np.diff(offsets) // 8) * (2 * half) + (v >> 48), v & ((1 << 48) - 1),
                            (word[-1] + 1) * 2 * half).reshape(-1, 2 * half)
            u = h[new]
            if last is not None:
                if u[0] == last:
                    x[0] += kept
                else:
                    yield found(np.array([last]), kept[None, :])
            last, kept = u[-1], x[-1].copy()
            if len(u) > 1:
                yield found(u[:-1], x[:-1])
        if last is not None:
            yield found(np.array([last]), kept[None, :])

    return A.map_arrow(seen.repartition("h").sortWithinPartitions("h"), run, A.struct(h="long", cls="long", c="long"))


@dataclass
class Lexicon:
    top: Words
    cls: np.ndarray  # of the words in the table, by rank
    core: int  # how many of them exchange has clustered
    words: DataFrame  # (h, cls, c) of all other words than the clustered ones
    n: int
    v: int
    classes: int


def lexicon(texts: DataFrame, s: Settings = Settings()) -> Lexicon:
    """Classes of all words of column ``text``."""
    counts = written(word_counts(texts), "word_counts")
    top = top_words(counts, s.lookup)
    core = top.first(min(s.clustered, len(top.count)))
    m = len(core.count)
    cells = neighbours(texts, core).toArrow()
    pairs = np.zeros((m + 2, m + 2))
    pairs[np.asarray(cells["a"]), np.asarray(cells["b"])] = np.asarray(cells["c"])
    own = exchange(pairs[:m, :m], s.classes, s.sweeps)
    words = written(join_classes(contexts(texts, core, own, s), *context_weights(pairs, own, core.count, s.classes)), "word_classes")
    cls = np.zeros(len(top.count), np.int64)
    cls[:m] = own
    if len(cls) > m:
        t = words.where(F.col("c") >= int(top.count[-1])).select("h", "cls").toArrow()
        cls[top.find(np.asarray(t["h"]).view(np.uint64))] = np.asarray(t["cls"])
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    return Lexicon(top, cls, m, words, int(total["n"]), int(total["v"]), s.classes)


FOUND = A.struct(rid="long", h="long", at="binary", n_words="long", n_known="long", base="double", emit="double", path="binary")
PATH = A.struct(n_words="long", n_known="long", base="double", emit="double", path="binary")


def paths(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None) -> DataFrame:
    """(id, train, n_words, n_known, base, emit, path) of each row: the classes of its tokens, a byte each (a
    word never seen: lex.classes, the end: one more), and the sums of log10(count + 1) and log10(count) over its known words."""
    handle, k_classes = docs.sparkSession.sparkContext.broadcast((lex.top, lex.cls)), lex.classes
    schema = T.StructType([*FOUND.fields, T.StructField("id", docs.schema[id_col].dataType), T.StructField("train", T.BooleanType())])

    def encode(batches):
        top, cls = handle.value
        n = len(top.count)
        known, emit = np.append(np.log10(top.count + 1), 0.0), np.append(np.log10(np.maximum(top.count, 1)), 0.0)
        mark = np.append(cls + ONCE * (top.count == 1), k_classes).astype(np.uint8)
        for b in batches:
            rid = np.asarray(b.column(0))
            for i, j, h, bounds in tokens(b.column(3)):
                r = top.find(h)
                k = j - i
                none = pa.nulls(k, pa.int64())
                own = [b.column(1).slice(i, k), b.column(2).slice(i, k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[i:j]), none, pa.nulls(k, pa.binary()), pa.array(np.diff(bounds)), pa.array(A.sums((r < n).astype(np.int64), bounds)),
                     pa.array(A.sums(known[r], bounds)), pa.array(A.sums(emit[r], bounds)),
                     _binary(with_ends(mark[r], bounds, k_classes + 1), bounds + np.arange(len(bounds))), *own], names=schema.names)
                # words outside the table, with their places, to be joined with all words
                out = np.flatnonzero(r == n)
                if len(out):
                    text = np.searchsorted(bounds, out, "right") - 1
                    by = np.lexsort((h[out], text))
                    hh, tt, at = h[out][by], text[by], (out - bounds[text])[by].astype(np.uint32)
                    f = np.flatnonzero(np.append(True, (hh[1:] != hh[:-1]) | (tt[1:] != tt[:-1])))
                    k = len(f)
                    none, nan = pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid[i:j][tt[f]]), pa.array(hh[f].view(np.int64)), _binary(at, np.append(f, len(hh))), none, none, nan, nan,
                         pa.nulls(k, pa.binary()), pa.nulls(k, b.column(1).type), pa.nulls(k, pa.bool_())], names=schema.names)

    def resolve(batches):
        for b in batches:
            n_known, base, emit = (np.array(b.column(k)) for k in (3, 4, 5))
            data, offsets = A.text_buffer(b.column(6))
            data = data.copy()
            more = b.column(7)
            size = np.asarray(pc.fill_null(pc.list_value_length(more), 0))
            flat = more.flatten()
            if len(flat):
                cls, c = np.asarray(flat.field("cls")), np.asarray(flat.field("c"))
                raw, at = A.text_buffer(flat.field("at"))
                times, row = np.diff(at) // 4, np.repeat(np.arange(len(size)), size)
                place = np.repeat(offsets[row], times) + np.frombuffer(raw.tobytes(), np.uint32)
                data[place] = np.repeat((cls + ONCE * (c == 1)).astype(np.uint8), times)
                n_known = n_known + np.bincount(row, times, len(size)).astype(np.int64)
                base = base + np.bincount(row, times * np.log10(c + 1), len(size))
                emit = emit + np.bincount(row, times * np.log10(c), len(size))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n_known), pa.array(base), pa.array(emit),
                                              _binary(data, offsets)], names=out.names)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(quoted(id_col)).alias("id"),
                       F.coalesce(F.lit(False) if train is None else train, F.lit(False)).alias("train"), F.col(quoted(text_col)).alias("text"))
    found = written(A.map_arrow(rows, encode, schema), "paths")
    rare = found.where(F.col("h").isNotNull()).select("rid", "h", "at").join(lex.words, "h")
    rare = rare.groupBy("rid").agg(F.collect_list(F.struct("cls", "c", "at")).alias("rare"))
    own = found.where(F.col("h").isNull()).select("rid", "id", "train", *PATH.names)
    out = T.StructType([schema["id"], schema["train"], *PATH.fields])
    return A.map_arrow(own.join(rare, "rid", "left").select("id", "train", *PATH.names, "rare"), resolve, out)


def transitions(known: DataFrame, n: int) -> DataFrame:
    """(a, b, c): class bigrams of the paths; a text begins after an end and ends with one. A word seen once is counted
    a second time as one of the unseen."""

    def run(batches):
        total = np.zeros(n * n, np.int64)
        for b in batches:
            path, _ = A.text_buffer(b.column(0))
            if not len(path):
                continue
            once, cls = path >= ONCE, (path & (ONCE - 1)).astype(np.int64)
            before, first = np.append(n - 1, cls[:-1]), np.append(False, once[:-1])
            total += np.bincount(before * n + cls, minlength=n * n)
            total += np.bincount(before[once] * n + n - 2, minlength=n * n)
            total += np.bincount((n - 2) * n + cls[first], minlength=n * n)
            total[(n - 2) * n + n - 2] += np.count_nonzero(first & once)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // n), pa.array(at % n), pa.array(total[at])], names=["a", "b", "c"])

    return A.map_arrow(known.select("path"), run, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    lexicon: Lexicon
    step: np.ndarray  # log10 of class transitions
    own: np.ndarray  # log10 of what a word's count is divided by in its class; for the unseen, of how many there are
    n: int
    v: int
    ends: int


def fit(known: DataFrame, lex: Lexicon, s: Settings = Settings()) -> Model:
    """The model from the paths of the training texts."""
    n = s.classes + 2
    cells = transitions(known, n).toArrow()
    g = np.zeros((n, n))
    g[np.asarray(cells["a"]), np.asarray(cells["b"])] = np.asarray(cells["c"])
    own = np.delete(g, s.classes, axis=0).sum(axis=0)  # tokens of each class
    ends = int(own[n - 1])
    # classes that no word has get no share
    real = own > 0
    real[n - 2:] = True
    share = (g.sum(axis=0) + 1) * real
    share /= share.sum()
    step = np.log10(np.maximum((g + s.prior * share) / (g.sum(axis=1, keepdims=True) + s.prior), 1e-300))
    own[n - 2:] = lex.v + 1, 1
    return Model(lex, step, np.log10(np.maximum(own, 1)), lex.n + ends, lex.v + bool(ends), ends)


def score(known: DataFrame, model: Model) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each path."""
    handle = known.sparkSession.sparkContext.broadcast((model.step, model.own, model.n, model.v, model.ends))
    schema = T.StructType([known.schema["id"], *A.struct(n_tokens="long", n_known="long", base_score="double", score="double").fields])

    def run(batches):
        step, own, n, v, ends = handle.value
        for b in batches:
            tokens, have, base, emit = (np.asarray(b.column(k)) for k in (1, 2, 3, 4))
            tokens = tokens + 1
            data, offsets = A.text_buffer(b.column(5))
            score = emit.copy()
            for i, j in A.chunks(offsets):
                cls = data[offsets[i]:offsets[j]] & (ONCE - 1)
                score[i:j] += A.sums(step[np.append(len(own) - 1, cls[:-1]).astype(np.int64), cls] - own[cls], offsets[i:j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(tokens), pa.array(have + bool(ends)),
                 pa.array(base + np.log10(ends + 1) - tokens * np.log10(n + v + 1)), pa.array(score)], names=schema.names)

    return A.map_arrow(known.select("id", *PATH.names), run, schema)


def perplexity(docs: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text",
               settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model learned from the rows that ``train_rows`` holds for, and the scores of all rows."""
    lex = lexicon(docs.where(train_rows).select(F.col(quoted(text_col)).alias("text")), settings)
    known = written(paths(docs, lex, id_col, text_col, train_rows), "class_paths")
    model = fit(known.where("train"), lex, settings)
    return model, score(known, model)


def held_out(id_col: str = "doc_id"):
    return L.held_out(id_col, 7, 2)
