"""Aggregates, ranks, splits, vocabulary and metrics against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexprep.operators import labels as L
from lexprep.operators import metrics as M
from lexprep.operators import split as S
from lexprep.operators import vocab as V
from lexprep.operators.ranking import global_row_number, range_buckets, rank_within
from lexprep.options import TopicOptions


def test_global_row_number_equals_window(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 20), f"k{rnd.randint(0, 999):03d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a long, b string")
    order = [F.desc("a"), F.asc("b"), F.asc("id")]
    got = global_row_number(df, order, [-F.col("a"), F.substring("b", 1, 2)], "rn")
    ref = df.withColumn("ref", F.row_number().over(Window.orderBy(*order)))
    joined = got.join(ref, "id")
    assert joined.where(F.col("rn") != F.col("ref")).count() == 0
    assert got.count() == 3000


@pytest.mark.parametrize("ids", [
    [*range(3000), 1 << 62],  # one far above
    [-(1 << 62), *range(3000)],  # one far below
    [*range(2000), *((1 << 45) + k for k in range(2000))],  # a crowd at either end
    [*range(0, 300000, 100)], [-(1 << 63), (1 << 63) - 1], [7], [None, 5, 6], []])
def test_ranks_of_crowded_ids(spark, ids):
    """All ids but one in one slice of the range: buckets stay small, and ranks equal those of a window."""
    df = spark.createDataFrame([(i, f"l{k % 3}") for k, i in enumerate(ids)], "id long, label string")
    coarse = range_buckets(df, "id")
    got = global_row_number(df, [F.col("id").asc()], coarse, "rn").collect()
    want = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sorted((r["rn"], r["id"]) for r in got) == list(enumerate(want, 1))
    largest = max((r["count"] for r in df.groupBy(*coarse).count().collect()), default=0)
    assert largest <= max(len(ids) / 256, 1)
    per = rank_within(df, "label", [F.col("id").asc()], coarse, "rank", "size").collect()
    of = {}
    for i, k in sorted(((i, f"l{k % 3}") for k, i in enumerate(ids)), key=lambda r: (r[0] is not None, r[0] or 0)):
        of.setdefault(k, []).append(i)
    assert sorted((r["label"], r["rank"], r["id"], r["size"]) for r in per) == sorted(
        (k, n, i, len(x)) for k, x in of.items() for n, i in enumerate(x, 1))


def test_latest_grades_keeps_last_and_groups_nulls(spark):
    rows = [(1, "u1", "g0"), (2, "u1", None), (3, None, "g1"), (4, None, "g2"), (5, "u2", "g3")]
    df = spark.createDataFrame(rows, "resp_id long, url string, grade string")
    got = {r.url: (r.resp_id, r.grade) for r in L.latest_grades(df).collect()}
    assert got == {"u1": (2, None), None: (4, "g2"), "u2": (5, "g3")}
    # the URL whose last answer has no grade is lost after the null drop
    ids = L.graded_ids(df).select("url").collect()
    assert {r.url for r in ids} == {"u2"}


def _sk_stratified_folds(y, k):
    """Stratified k-fold without shuffle, from its public description: classes by first appearance."""
    classes = list(dict.fromkeys(y))
    enc = [classes.index(v) for v in y]
    y_order = sorted(enc)
    alloc = [[sum(1 for v in y_order[i::k] if v == c) for c in range(len(classes))] for i in range(k)]
    folds = [None] * len(y)
    for c in range(len(classes)):
        seq = [f for f in range(k) for _ in range(alloc[f][c])]
        idx = [i for i, v in enumerate(enc) if v == c]
        for i, f in zip(idx, seq):
            folds[i] = f
    return folds


def test_stratified_folds_match_reference_allocation(spark):
    rnd = random.Random(3)
    for n, k in ((97, 5), (40, 3), (13, 5)):
        y = [1] + [rnd.choice([0, 0, 1, 2]) for _ in range(n - 1)]
        df = spark.createDataFrame(list(enumerate(y)), "id long, label long")
        got = {r.id: r.fold for r in S.stratified_folds(df, "id", "label", k).collect()}
        assert [got[i] for i in range(n)] == _sk_stratified_folds(y, k)


def test_stratified_split_proportions(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "id long, label long")
    got = S.stratified_split(df, "id", "label", 0.2, 42).groupBy("label", "split").count().collect()
    c = {(r.label, r.split): r["count"] for r in got}
    assert c[(1, "test")] == math.ceil(0.2 * 100) and c[(0, "test")] == math.ceil(0.2 * 200)


def test_random_split_is_stable_when_rows_are_added(spark):
    a = S.random_split(spark.range(0, 500).withColumnRenamed("id", "id"), "id", 0.25, 42)
    b = S.random_split(spark.range(0, 1000), "id", 0.25, 42).where("id < 500")
    assert a.exceptAll(b).count() == 0
    frac = a.where("split = 'test'").count() / 500
    assert 0.18 < frac < 0.32


def test_contrastive_pairs_partners(spark):
    df = spark.createDataFrame([(i, int(i < 6)) for i in range(20)], "id long, label long")
    pairs = S.contrastive_pairs(df, "id", "label", iterations=4).collect()
    lab = {i: int(i < 6) for i in range(20)}
    assert len(pairs) == 20 * 4 * 2
    for p in pairs:
        assert (lab[p.id_a] == lab[p.id_b]) == (p.similarity == 1.0)


def test_contrastive_pairs_of_more_classes(spark):
    lab = {i: i % 3 + 4 for i in range(21)}
    df = spark.createDataFrame(list(lab.items()), "id long, label long")
    pairs = S.contrastive_pairs(df, "id", "label", iterations=4).collect()
    assert len(pairs) == 21 * 4 * 2
    assert all((lab[p.id_a] == lab[p.id_b]) == (p.similarity == 1.0) for p in pairs)
    other = {(lab[p.id_a], lab[p.id_b]) for p in pairs if p.similarity == 0.0}
    assert len(other) == 6
    one = S.contrastive_pairs(df.where("label = 4"), "id", "label", iterations=2).collect()
    assert len(one) == 14 and {p.similarity for p in one} == {1.0}


def test_whole_test_part(spark):
    df = spark.range(100)
    assert S.random_split(df, "id", 1.0).where("split = 'test'").count() == 100
    assert S.random_split(df, "id", 0.0).where("split = 'test'").count() == 0


def _py_vocab(docs, max_df, min_df, pattern):
    import re

    n = len(docs)
    df = Counter()
    for d in docs:
        toks = re.findall(pattern, d.lower())
        grams = toks + [" ".join(toks[i:i + 2]) for i in range(len(toks) - 1)]
        df.update(set(grams))
    return {t: c for t, c in df.items() if min_df <= c <= max_df * n}


def test_vocabulary_and_prune_match_python(spark):
    docs = ["alpha beta gamma", "alpha beta", "alpha ética zeta", "beta beta delta", "x1 alpha", "tica"]
    df = spark.createDataFrame([("c", i, d) for i, d in enumerate(docs)], "corpus string, doc_id long, text string")
    for min_df in (1, 2):
        opts = TopicOptions(min_df=min_df, max_df=0.5, token_pattern="letter_word")
        got = {r.term: r.df for r in V.vocabulary(df, "text", opts).collect()}
        ref = _py_vocab(docs, 0.5, min_df, r"[a-zA-Z]\w*")
        assert got == ref
        pruned = {r.doc_id: r.text for r in V.vocabulary_filter(df, "text", opts).collect()}
        for i, d in enumerate(docs):
            assert pruned[i] == " ".join(w for w in d.split() if w.lower() in ref)


def test_vocabulary_filter_compares_lower_case(spark):
    docs = ["Casa casa", "casa livro", "pedra", "Livro"]
    df = spark.createDataFrame([("c", i, d) for i, d in enumerate(docs)], "corpus string, doc_id long, text string")

    def kept(**kw):
        opts = TopicOptions(token_pattern="letter_word", **kw)
        return [r.text for r in V.vocabulary_filter(df, "text", opts).orderBy("doc_id").collect()]

    assert kept(min_df=1, max_df=0.4) == ["", "", "pedra", ""]
    assert kept(min_df=2, max_df=1.0) == ["Casa casa", "casa livro", "", "Livro"]
    assert kept(min_df=1, max_df=1.0) == docs


def test_confusion_and_report(spark):
    y = [0, 0, 1, 1, 1, 2]
    p = [0, 1, 1, 1, 0, 1]
    df = spark.createDataFrame(list(zip(y, p)), "label long, prediction long")
    cm = {(r.label, r.prediction): r.n for r in M.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[(1, 1)] == 2 and cm[(2, 2)] == 0
    rep = {r.row: r for r in M.classification_report(df).collect()}
    # class 1: predicted 4 times, 2 right, 3 true
    assert rep["1"].precision == 2 / 4 and rep["1"].recall == 2 / 3
    assert rep["2"].f1 == 0.0 and rep["accuracy"].f1 == 3 / 6
    f1_0, f1_1 = 0.5, 2 * 0.5 * (2 / 3) / (0.5 + 2 / 3)
    assert abs(rep["macro avg"].f1 - (f1_0 + f1_1 + 0) / 3) < 1e-12
    assert abs(rep["weighted avg"].f1 - (2 * f1_0 + 3 * f1_1) / 6) < 1e-12


def test_smoothed_f1_half_even(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.51), (0, 0.5), (1, 0.2)], "label long, prob double")
    r = M.smoothed_f1(df).first()
    tp, pos, pp = 1.0, 3.0, 1.0  # rint(0.5) = 0, rint(0.51) = 1
    prec, rec = tp / (pp + 1e-7), tp / (pos + 1e-7)
    assert abs(r.precision - prec) < 1e-12 and abs(r.recall - rec) < 1e-12


def test_vocabulary_filter_paths_agree_with_brute_force(spark):
    """Both ways of pruning: heavy words taken to the documents, and postings against the vocabulary."""
    import random
    import re
    from collections import Counter

    from lexprep.operators import vocab as V
    from lexprep.options import TopicOptions

    rng = random.Random(3)
    words = ["Lei", "lei", "dado", "DADO", "9abc", "a-b", "x", "réu", "ação", "uma1", "só", "zz", "_q", "the"]
    rows = [(c, i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for c in ("p", "q") for i in range(30)] + [("p", 99, ""), ("q", 98, "único")]
    docs = spark.createDataFrame([(c, i, t, 1) for c, i, t in rows], "corpus string, doc_id long, text string, n int")
    for opts in (TopicOptions(min_df=1, max_df=0.4), TopicOptions(min_df=3, max_df=0.4), TopicOptions(min_df=2, max_df=1.0)):
        got = {(r["corpus"], r["doc_id"]): r["text"] for r in V.vocabulary_filter(docs, "text", opts).collect()}
        for c in ("p", "q"):
            own = [(i, t) for k, i, t in rows if k == c]
            df = Counter(w for _, t in own for w in set(re.findall(r"[a-z]\w*", t.lower())))
            keep = {w for w, n in df.items() if opts.min_df <= n <= opts.max_df * len(own)}
            for i, t in own:
                assert got[c, i] == " ".join(w for w in t.split() if w.lower() in keep)


def test_no_exchange_carries_single_positions(spark):
    from lexprep.operators import vectors as X
    from lexprep.operators import vocab as V

    docs = spark.createDataFrame([("p", 1, "a b")], "corpus string, doc_id long, text string")
    plan = V.vocabulary_filter(docs)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan
    index = spark.createDataFrame([("a", 1)], "token string, idx long")
    plan = X.padded_sequences(docs, index)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list(pos" in plan  # positions of a word are one row before they are shuffled


def test_a_token_is_looked_up_in_one_short_bucket_of_heavy_words(spark):
    from lexprep.operators import vocab as V

    words = [f"w{i}" for i in range(3000)]
    rows = [("p", i, " ".join(words + [f"own{i}"])) for i in range(4)]
    docs = spark.createDataFrame(rows, "corpus string, doc_id long, text string")
    heavy = V.heavy_terms(docs, "text", TopicOptions(min_df=1, max_df=0.5, token_pattern="letter_word"))
    buckets = V.heavy_buckets(heavy).first()["buckets"]
    assert len(buckets) == V.HEAVY_BUCKETS and sorted(w for b in buckets for w in b) == sorted(words)
    assert max(map(len, buckets)) < 50
    kept = V.vocabulary_filter(docs, "text", TopicOptions(min_df=1, max_df=0.5, token_pattern="letter_word"))
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {i: f"own{i}" for i in range(4)}


def test_pruning_of_tokens_counts_no_bigrams(spark):
    from lexprep.operators import vocab as V

    docs = spark.createDataFrame([("p", 1, "a b")], "corpus string, doc_id long, text string")
    pair = "(?<![^ ])"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert pair in plan(V.vocabulary(docs, "text", TopicOptions(min_df=2, max_df=0.5, token_pattern="letter_word")))
    assert pair not in plan(V.vocabulary_filter(docs, "text", TopicOptions(min_df=2, max_df=0.5, token_pattern="letter_word")))


def test_tfidf_counts_in_the_row_and_sorts_no_pairs(spark, capsys):
    docs = spark.createDataFrame([(1, "bb aa bb"), (1, "aa cc"), (2, "cc"), (3, None), (None, "dd dd"), (4, "")], "id long, text string")
    from lexprep.operators import vectors as X

    got = X.tfidf(docs, "id", "text", max_df=1.0, stopwords=[])
    rows = {(r["id"], r["term"]): (r["tf"], r["df"]) for r in got.collect()}
    assert rows == {(1, "aa"): (2, 1), (1, "bb"): (2, 1), (1, "cc"): (1, 2), (2, "cc"): (1, 2), (None, "dd"): (2, 1)}
    n = 4  # ids with a text: 1, 2, null and 4
    w = {k: tf * (math.log((1 + n) / (1 + df)) + 1) for k, (tf, df) in rows.items()}
    for r in got.collect():
        norm = math.sqrt(sum(x * x for (i, _), x in w.items() if i == r["id"]))
        assert abs(r["tfidf"] - w[r["id"], r["term"]] / norm) < 1e-12
    got.explain()
    plan = capsys.readouterr().out
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan
    assert not re.search(r"HashAggregate\(keys=\[[^\]]*id#\w+, term#", plan)


def test_pruning_rare_words_shuffles_no_postings(spark):
    """Texts and rare words meet by document: no row for each document and word is shuffled or collected."""
    from lexprep.operators import vocab as V

    docs = spark.createDataFrame([("p", 1, "a b")], "corpus string, doc_id long, text string")
    plan = V.vocabulary_filter(docs, "text", TopicOptions(min_df=2, max_df=0.5, token_pattern="letter_word"))._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "collect_list(struct(pos" not in plan


def test_rows_of_one_document_and_rows_without_a_key(spark):
    """Rows of an id are one document, with the tokens of all by position; a row without corpus or id keeps none."""
    from lexprep.operators import vocab as V

    own = " ".join(f"own{i}" for i in range(3 * V.RARE_LIST))
    rows = [("p", 1, "b a", 1), ("p", 1, "c a b", 2), ("p", 2, f"a {own} b own5", 3), ("p", 3, None, 4), ("p", None, "a b", 5),
            ("p", None, "a b", 6), (None, 4, "a b", 7), ("p", 5, "solo", 8), ("q", 1, "a b", 9)]
    docs = spark.createDataFrame(rows, "corpus string, doc_id long, text string, n int").repartition(3)
    for min_df, want in ((2, {1: "b a a b", 2: "b a a b", 3: "a b", 9: ""}), (3, {1: "b a a b", 2: "b a a b", 3: "a b", 9: ""})):
        got = V.vocabulary_filter(docs, "text", TopicOptions(min_df=min_df, max_df=1.0, token_pattern="letter_word"))
        assert got.columns == docs.columns
        assert {r["n"]: r["text"] for r in got.collect()} == {n: "" for n in range(4, 9)} | want
