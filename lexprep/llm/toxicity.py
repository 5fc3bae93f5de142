"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability comes from a
linear model over its hashed words; the document's is their
noisy-or, one minus the product of what is left. Only documents have labels,
so the gradient of the document's loss is shared out among its sentences,
mostly to those that already look guilty. Trained, the model scores
documents and points at the sentences that made the score.

Training is numpy on a bounded sample of labelled documents
(``Settings.max_docs``, ``max_bytes``); the model that is broadcast is a
table of ``buckets`` numbers. Scoring reads whole texts in one pass without a
shuffle. A text without words has no guilty sentence: score 0. Without any
usable label all scores are those of the untrained bias. Labels, ids and
other columns are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexprep.llm import arrow as A
from lexprep.llm import labelled as L


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    epochs: int = 12
    rate: float = 1.0
    decay: float = 1e-3  # pulls the weights of a step's words to zero
    min_docs: int = 10  # words of fewer training documents get no weight
    bias: float = -7.0
    max_docs: int = 12000
    max_bytes: int = 48 << 20
    seed: int = 23


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float
    settings: Settings


#: a sentence ends at one of these bytes
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True

SENTENCE = T.StructType([T.StructField("sentence", T.LongType()), T.StructField("first_byte", T.LongType()),
                         T.StructField("n_bytes", T.LongType()), T.StructField("probability", T.DoubleType())])
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.LongType()),
                       T.StructField("offending", T.ArrayType(SENTENCE))])


def instances(data: np.ndarray, offsets: np.ndarray, s: Settings):
    """(ids, first, doc, from, to): hashed words by sentence; sentence k has ids first[k]..first[k+1],
    lies in text doc[k] and spans bytes from[k]..to[k] from its first word to its last."""
    shift = np.uint64(64 - (s.buckets - 1).bit_length())
    starts, ends, h, bounds = A.words(data, offsets, A.ALNUM)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, np.zeros(1, np.int64), none, none, none
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ENDS[data], out=stops[1:])
    new = np.ones(n, bool)
    new[1:] = stops[starts[1:]] > stops[ends[:-1]]
    new[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    ids = (A.mix(h) >> shift).astype(np.int64)
    f = np.flatnonzero(new)
    return (ids, np.append(f, n), np.searchsorted(bounds, f, "right") - 1, starts[f],
            ends[np.append(f[1:], n) - 1])


def train(sample: list[tuple[str, int]], s: Settings = Settings()) -> Model:
    """Fit on (text, 0/1) pairs: gradient steps on the loss of one document's noisy-or."""
    rng = np.random.default_rng(s.seed)
    w, bias = np.zeros(s.buckets), s.bias
    known = np.zeros(s.buckets, np.int64)
    rows = []
    for text, label in sample:
        ids, first, *_ = instances(*A.text_buffer(pa.array([text], pa.large_string())), s)
        if len(ids):
            rows.append((ids.astype(np.int32), first, int(label)))
            known[np.unique(ids)] += 1
    known = known >= s.min_docs
    for epoch in range(s.epochs):
        rate = s.rate * (1 - 0.8 * epoch / s.epochs)
        for k in rng.permutation(len(rows)):
            ids, first, y = rows[k]
            z = np.add.reduceat(w[ids], first[:-1]) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            log_none = -np.logaddexp(0, z).sum()  # of no sentence being toxic
            if y:
                none = np.exp(max(log_none, -30.0))
                g = -p * min(none / max(1 - none, 1e-9), 50.0)
            else:
                g = p
            # a long bag must not outweigh a short one
            g = np.clip(g, -1, 1)
            step = np.repeat(g, np.diff(first))
            u, back = np.unique(ids, return_inverse=True)
            gu = np.clip(np.bincount(back, step, len(u)), -1, 1)
            w[u] -= np.where(known[u], rate * (gu + s.decay * w[u]), 0)
            bias -= 0.002 * rate * float(np.clip(g.sum(), -1, 1))
    return Model(w.astype(np.float32), float(bias), s)


def score_texts(data: np.ndarray, offsets: np.ndarray, model: Model, guilt: float = 0.3):
    """Scores, numbers of sentences, and (text, sentence, first byte, bytes, probability) of sentences from ``guilt`` on."""
    n = len(offsets) - 1
    score, count, found = np.zeros(n), np.zeros(n, np.int64), []
    for i, j in A.chunks(offsets):
        base = offsets[i]
        ids, first, doc, a, b = instances(data[base:offsets[j]], offsets[i:j + 1] - base, model.settings)
        if not len(ids):
            continue
        z = A.sums(model.weight[ids].astype(np.float64), first) + model.bias
        log_none = np.bincount(doc, -np.logaddexp(0, z), j - i)
        score[i:j] = -np.expm1(log_none)
        count[i:j] = np.bincount(doc, minlength=j - i)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        at = np.flatnonzero(p >= guilt)
        head = np.searchsorted(doc, doc[at])  # first sentence of the same text
        found.append((doc[at] + i, at - head, a[at] + base - offsets[doc[at] + i], b[at] - a[at], p[at]))
    cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
    return np.clip(score, 0, 1), count, cols


def with_score(docs: DataFrame, model: Model, name: str, text_col: str = "text", guilt: float = 0.3) -> DataFrame:
    """``docs`` and a struct ``name``: score, n_sentences, and the offending sentences, whose probability is at
    least ``guilt``, with where they stand in the text's UTF-8 bytes."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = handle.value

        def of(col):
            data, offsets = A.text_buffer(col)
            score, count, (doc, sentence, first, size, p) = score_texts(data, offsets, model, guilt)
            items = pa.StructArray.from_arrays(
                [pa.array(sentence, pa.int64()), pa.array(first, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(p, pa.float64())], [f.name for f in SENTENCE])
            at = np.searchsorted(doc, np.arange(len(col) + 1)).astype(np.int32)
            return {"score": pa.array(score, pa.float64()), "n_sentences": pa.array(count, pa.int64()),
                    "offending": pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)}

        return of

    return A.with_result(docs, text_col, name, RESULT, make)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 4, remainder: int = 2,
        settings: Settings = Settings(), **columns) -> Model:
    """Train on the labelled rows whose id is not held out."""
    return train(L.training_sample(docs, labels, label_col, modulus, remainder, settings.max_docs,
                                   settings.max_bytes, seed=settings.seed, **columns), settings)


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text",
                 settings: Settings = Settings()) -> DataFrame:
    """The documents whose score is under ``threshold``, with the columns they came with."""
    name = A.free_name(docs, "toxicity")
    scored = with_score(docs, fit(docs, labels, settings=settings), name, text_col)
    return scored.where(F.col(name)["score"] < threshold).select(*docs.columns)
