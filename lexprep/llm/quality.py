"""Quality classifier by supervised subword embeddings.

Each text is the bag of its words and of its character n-grams, hashed into
buckets. Buckets have learned vectors; a text's vector is their mean, and a
softmax over a linear output gives the class. The vectors and the output are
trained together, by stochastic gradient descent in numpy, on a bounded
sample of labelled documents (``Settings.max_docs``, ``max_bytes``).

A text's score is linear in its mean vector, so scoring needs one number for
each bucket: the model that is broadcast is a table of ``buckets`` numbers.
Scoring reads every byte of every text in one pass without a shuffle. An
empty or null text has the zero vector: its score is that of the bias.
Without any usable label all scores are 0.5. Labels, ids and other columns
are never inputs.
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


#: Bytes of text that are scored at once: the work arrays of a chunk take some 60 times its size.
SCORE_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    dim: int = 16
    grams: tuple[int, ...] = (3, 5)
    epochs: int = 6
    rate: float = 0.2
    max_docs: int = 6000
    max_bytes: int = 32 << 20
    seed: int = 17


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of each bucket: what its vector adds to the log odds of class 1
    bias: float
    settings: Settings


def features(data: np.ndarray, offsets: np.ndarray, s: Settings):
    """For each kind of feature: bucket numbers in text order, and where each text's begin and end."""
    shift = np.uint64(64 - (s.buckets - 1).bit_length())
    _, _, h, bounds = A.words(data, offsets, A.NONSPACE, fold=False)
    yield (A.mix(h + np.uint64(1)) >> shift).astype(np.int64), bounds[:-1], bounds[1:]
    prefix = A.prefix_hash(data)
    for n in s.grams:
        ids = (A.gram_hash(prefix, n) >> shift).astype(np.int64)
        # grams that begin in a text and end in it
        yield ids, np.minimum(offsets[:-1], len(ids)), np.clip(offsets[1:] - n + 1, np.minimum(offsets[:-1], len(ids)), len(ids))


def train(sample: list[tuple[str, int]], s: Settings = Settings()) -> Model:
    """Fit vectors and output on (text, 0/1) pairs, one document a step, with steps scaled by past gradients."""
    rng = np.random.default_rng(s.seed)
    vec = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    rows = []
    for text, label in sample:
        data, offsets = A.text_buffer(pa.array([text], pa.large_string()))
        ids = np.concatenate([i[a[0]:b[0]] for i, a, b in features(data, offsets, s)])
        u, c = np.unique(ids, return_counts=True)
        if len(ids):
            rows.append((u.astype(np.int32), (c / len(ids)).astype(np.float32), int(label)))
    seen, seen_out = np.full(s.buckets, 1e-8, np.float32), np.full((s.dim, 2), 1e-8, np.float32)
    mean = [np.mean([y == k for _, _, y in rows]) if rows else 0.5 for k in (0, 1)]
    if min(mean) <= 0:  # one class only, or nothing: the share of class 1 for all
        return Model(np.zeros(s.buckets, np.float32), 0.0 if not rows else 6.0 * (mean[1] - mean[0]), s)
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for k in rng.permutation(len(rows)):
            u, c, y = rows[k]
            own = vec[u]
            v = c @ own
            z = v @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            g = np.outer(v, p)
            seen_out += g * g
            out -= rate * g / np.sqrt(seen_out)
            bias -= 0.1 * rate * p
            seen[u] += c * c * float(back @ back)
            vec[u] = own - (rate * c / np.sqrt(seen[u]))[:, None] * back[None, :]
    return Model((vec @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), s)


def score_texts(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Probability of class 1 of each text."""
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for i, j in A.chunks(offsets, SCORE_BYTES):
        for ids, a, b in features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], model.settings):
            run = np.zeros(len(ids) + 1)
            np.cumsum(model.weight[ids], out=run[1:])
            total[i:j] += run[b] - run[a]
            count[i:j] += b - a
    z = total / np.maximum(count, 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def with_score(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` and a struct ``name`` with the score of each row's text."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = handle.value

        def of(col):
            return {"score": pa.array(score_texts(*A.text_buffer(col), model), pa.float64())}

        return of

    return A.with_result(docs, text_col, name, T.StructType([T.StructField("score", T.DoubleType())]), make)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 3, remainder: int = 1,
        settings: Settings = Settings(), **columns) -> Model:
    """Train on the labelled rows whose id is not held out."""
    model = train(L.training_sample(docs, labels, label_col, modulus, remainder, settings.max_docs,
                                    settings.max_bytes, seed=settings.seed, **columns), settings)
    A.release()  # the bags of the sample
    return model


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text",
              settings: Settings = Settings()) -> DataFrame:
    """The documents whose score is at least ``threshold``, with the columns they came with."""
    name = A.free_name(docs, "quality")
    scored = with_score(docs, fit(docs, labels, settings=settings), name, text_col)
    return scored.where(F.col(name)["score"] >= threshold).select(*docs.columns)
