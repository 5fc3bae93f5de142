"""Supervised n-gram embeddings: separable text is learnt, the fit is that of dense numpy, odd rows, hot buckets."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from lexprep.operators import ngram_embedding as N
from lexprep.plans import q_models

SMALL = N.Settings(n=2, buckets=1 << 14, dim=4, rounds=4, tolerance=0.0)


def _toy(spark, n=90):
    topics = ["lgpd dados titular", "contrato aluguel fiador", "pena prisao reu"]
    return spark.createDataFrame([(i, f"{topics[i % 3]} caso {i}", i % 3) for i in range(n)], "id long, text string, label long")


def test_held_out_rows_and_a_saved_model(spark):
    toy = _toy(spark)
    model = N.fit(toy.where("id < 60"), settings=SMALL)
    assert model.losses == sorted(model.losses, reverse=True) and model.losses[-1] < 0.2 * model.losses[0]
    got = model.scored(toy).orderBy("id").collect()
    assert [r.prediction for r in got] == [r.label for r in got] and len(got) == 90
    path = os.path.join(tempfile.mkdtemp(prefix="lexprep-ngrams-"), "m")
    model.save(path)
    assert N.load(spark, path).scored(toy).orderBy("id").collect() == got


def test_word_order_is_learnt_from_grams(spark):
    rows = [(i, ("a b" if i % 2 else "b a") + f" x{i // 2}", i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string, label long")
    model = N.fit(docs.where("id < 40"), settings=SMALL)
    assert model.scored(docs.where("id >= 40")).where("prediction != label").count() == 0


def test_gradient_and_loss_equal_dense_algebra(spark):
    """Vectors found by joins give the recorded loss when the same model is put together densely."""
    toy = _toy(spark, 30)
    two = N.fit(toy, settings=N.Settings(n=2, buckets=1 << 14, dim=4, rounds=2, tolerance=0.0))
    three = N.fit(toy, settings=N.Settings(n=2, buckets=1 << 14, dim=4, rounds=3, tolerance=0.0))
    vectors = {r.bucket: np.array(r[1:]) for r in two.vectors.collect()}
    hidden = np.zeros((30, 4))
    for r in N.grams(toy, "id", "text", two.settings).collect():
        hidden[r.id] += r.weight * vectors[r.bucket]
    scores = two.prior + hidden @ two.head.T
    loss = np.mean(np.log(np.exp(scores).sum(1)) - scores[np.arange(30), np.arange(30) % 3])
    assert abs(loss - three.losses[2]) < 1e-9 and three.losses[:2] == two.losses


def test_hot_buckets_in_parts_give_the_same_model(spark, monkeypatch):
    toy = _toy(spark, 45)
    whole = N.fit(toy, settings=SMALL)
    monkeypatch.setattr(N, "PART_ROWS", 7)
    parts = N.fit(toy, settings=SMALL)
    assert np.allclose(whole.head, parts.head) and np.allclose(whole.losses, parts.losses)


def test_empty_repeated_and_null_rows(spark):
    rows = [(1, "x y", 0), (1, "x y", 0), (2, None, 0), (3, "", 0), (4, "z", 1), (5, "x", None), (None, "z", 1)]
    docs = spark.createDataFrame(rows, "id long, text string, label long").withColumn("bucket", F.lit("own"))
    model = N.fit(docs, settings=SMALL)
    got = {(r.id, r.text): (r.prediction, r.bucket) for r in model.scored(docs).collect()}
    assert got[(2, None)] == got[(3, "")] == (0, "own") and got[(1, "x y")][0] == 0 and got[(4, "z")][0] == 1
    assert model.scored(docs).count() == 7 and model.scored(docs.limit(0)).count() == 0
    one = N.fit(docs.where("label = 0"), settings=SMALL)
    assert {r.prediction for r in one.scored(docs).collect()} == {0}


def test_weights_of_a_document_add_up(spark):
    w = N.grams(_toy(spark, 5), "id", "text", SMALL).groupBy("id").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert all(abs(r.w - 1) < 1e-12 and r.n == 11 for r in w)  # 6 words with the end, 5 pairs


def test_vectors_are_not_held_by_the_driver(spark):
    assert N.Settings().buckets == 1 << 21 and q_models.N.fit is N.fit
    plan = N.fit(_toy(spark, 12), settings=SMALL).scored(_toy(spark, 12))._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "LocalRelation" not in plan


def test_buckets_are_hashes_of_word_slices(spark):
    docs = spark.createDataFrame([(1, "a b a  b c"), (1, "c"), (2, "a")], "id long, text string")
    got = {(r.id, r.bucket): r.weight for r in N.grams(docs, "id", "text", N.Settings()).collect()}
    words = {1: [["a", "b", "a", "b", "c", N.END], ["c", N.END]], 2: [["a", N.END]]}
    want = {}
    for i, texts in words.items():
        met = [w[a:a + k] for w in texts for k in (1, 2, 3) for a in range(len(w) - k + 1)]
        for g in met:
            b = spark.range(1).select(F.pmod(F.xxhash64(F.array(*map(F.lit, g))), F.lit(1 << 21))).first()[0]
            want[i, b] = want.get((i, b), 0) + 1 / len(met)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_rounds_join_cells_and_not_single_grams(spark):
    """Between rounds the training grams are a few packed rows, one for each block and part of the buckets."""
    toy = _toy(spark, 60)
    kept = N._Grams(toy, "id", "text", 60, SMALL)
    grams = N.grams(toy, "id", "text", SMALL)
    assert kept.cells.count() <= N.PARTS < grams.count()
    assert sum(len(r.weight) // 8 for r in kept.cells.collect()) == grams.count()
    kept.free()
