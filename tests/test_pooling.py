"""Pooled embeddings: brute force on odd rows, and no vector sent for each word of a document."""

import random

import pytest
from pyspark.sql import functions as F

from lexprep.operators import vectors as X


def _brute(docs, vectors):
    words, dim = {}, max(len(v) for _, v in vectors)
    for i, text in docs:
        if text is not None:
            words.setdefault(i, []).extend(text.split(" "))
    total = {i: [0.0] * dim for i in words}
    for i, ws in words.items():
        for w in ws:
            for _, v in (x for x in vectors if x[0] == w):
                for k, value in enumerate(v):
                    total[i][k] += value
    return {i: [x / len(words[i]) for x in t] for i, t in total.items()}


@pytest.mark.parametrize("dim", [1, 16, 17, 40])
def test_means_equal_brute_force(spark, dim):
    rnd = random.Random(dim)
    vocabulary = [f"w{i}" for i in range(30)] + [""]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60)))) for i in range(250)]
    docs += [(3, "w1 w1 zz"), (3, "w1 w1 zz"), (None, "w2 w3"), (900, None), (901, ""), (902, "unknown words only")]
    vectors = [(w, [rnd.uniform(-1, 1) for _ in range(dim)]) for w in vocabulary[:20]] + [("w1", [0.5] * dim), ("w4", [])]
    got = X.pooled_embeddings(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame(vectors, "word string, vector array<float>"))
    want, rows = _brute(docs, vectors), {r.doc_id: r.embedding for r in got.collect()}
    assert rows.keys() == want.keys() and got.count() == len(want)
    for i, v in want.items():
        assert rows[i] == pytest.approx(v, abs=1e-6), i


def test_documents_are_summed_where_their_counts_are(spark):
    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(40)], "doc_id long, text string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 4.0])], "word string, vector array<float>")
    out = X.pooled_embeddings(docs, vectors)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    sums = plan[plan.index("ObjectHashAggregate"):]  # the final plan stands before the initial one
    above = sums[:sums.index("Window [")]
    assert "HashAggregate" in above and "Exchange" not in above and "Join" not in above


def test_sequences_meet_the_index_by_distinct_words_of_a_block(spark, monkeypatch):
    docs = [(7, "b a b x"), (7, "c a"), (8, None), (9, ""), (None, "a"), (10, "A,b\ta  zz a")] + [(i, f"a own{i}") for i in range(20, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "token string, idx long")
    for size in (X.SEQ_BLOCK_BYTES, 8):
        monkeypatch.setattr(X, "SEQ_BLOCK_BYTES", size)
        got = X.padded_sequences(df, index, maxlen=4).collect()
        assert len(got) == len(docs)
        seqs = {r.doc_id: (r.n_ids, r.seq) for r in got}
        # the texts of one id are read side by side: first words, then second words
        assert seqs[7] == (5, [3, 1, 1, 2]) and seqs[10] == (4, [1, 2, 1, 1]) and seqs[20] == (1, [1, 0, 0, 0])
        assert seqs[8] == seqs[9] == seqs[None] == (0, [0, 0, 0, 0])
    plan = X.padded_sequences(df, index)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row for each document and word


def test_index_of_texts_counts_the_training_rows(spark):
    rows = [(1, "b a b"), (1, "c a"), (2, "c c d"), (3, "d e e e"), (None, "b"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.where("doc_id is null or doc_id != 3")
    want = X.token_index(train).orderBy("idx").collect()
    got = X.token_index_of_texts(X.seq_texts(df), F.coalesce(F.col("doc_id") != 3, F.lit(True)), train).orderBy("idx").collect()
    assert got == want and [r.n for r in got] == [3, 3, 2, 1]
