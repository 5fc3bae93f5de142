"""Queries of splits, pair mining and metrics.

Predictions come from a fixed rule over the test tables (fixtures), so
every metric has an exact oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexprep.operators import metrics as M
from lexprep.operators import split as S
from lexprep.operators.ranking import range_buckets
from lexprep.plans import oracle as O
from lexprep.plans.catalog import register
from lexprep.plans.q_text import labelled_clean
from lexprep.sources import fixtures as X

SEED = 42
R6 = 6


def _r(cols):
    return [F.round(c, R6).alias(c) for c in cols]


def _labelled_ids(spark, sf):
    return labelled_clean(spark, sf).select("id", "label")


_LABELLED_IDS = O.with_(O.RESPONSES, O.LATEST, O.GRADED, O.DECISIONS, O.LABELLED,
                        "ids AS (SELECT resp_id AS id, label FROM labelled WHERE html IS NOT NULL)")


def _md5(id_expr: str) -> str:
    return f"md5('{SEED}|' || CAST({id_expr} AS VARCHAR))"


@register("random_split", _LABELLED_IDS + f"""
SELECT id, label, CASE WHEN substr({_md5('id')}, 1, 8) < '{S.hash_threshold(0.2)}' THEN 'test' ELSE 'train' END AS split
FROM ids""")
def random_split(spark, sf):
    """20% hold-out, seed 42, of the labelled documents."""
    return S.random_split(_labelled_ids(spark, sf), "id", 0.2, SEED)


@register("stratified_split", _LABELLED_IDS + f"""
SELECT id, label,
  CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_md5('id')}, id) <= ceil(0.2 * count(*) OVER (PARTITION BY label))
       THEN 'test' ELSE 'train' END AS split
FROM ids""")
def stratified_split(spark, sf):
    """20% stratified hold-out of the labelled documents."""
    return S.stratified_split(_labelled_ids(spark, sf), "id", "label", 0.2, SEED)


def _folds_sql(k: int = 5) -> str:
    def upto(x: str, i: int) -> str:
        return f"greatest(floor(({x} - {i} + {k - 1}) / {k}), 0)"

    alloc = [f"({upto('s + n', i)} - {upto('s', i)})" for i in range(k)]
    bounds = [" + ".join(alloc[: i + 1]) for i in range(k - 1)]
    fold = " + ".join(f"CASE WHEN j >= {b} THEN 1 ELSE 0 END" for b in bounds)
    return O.with_(O.PREDICTIONS, "p AS (SELECT doc_id AS id, label FROM predictions)") + f""",
cls AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT label, count(*) AS n, min(id) AS first FROM p GROUP BY label)),
r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS j FROM p)
SELECT r.id, r.label, CAST({fold} AS BIGINT) AS fold FROM r JOIN cls USING (label)"""


@register("stratified_folds", _folds_sql(5))
def stratified_folds(spark, sf):
    """5 stratified folds of the labelled predictions table."""
    p = X.predictions(spark, sf).select(F.col("doc_id").alias("id"), "label")
    return S.stratified_folds(p, "id", "label", 5)


@register("contrastive_pairs", _LABELLED_IDS + f""",
r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_md5('id')}, id) AS rk,
             count(*) OVER (PARTITION BY label) AS n FROM ids),
sz AS (SELECT DISTINCT label, n FROM r),
it AS (SELECT r.*, i.iteration FROM r, (SELECT unnest(generate_series(1, 20)) AS iteration) i)
SELECT CAST(it.iteration AS BIGINT) AS iteration, it.id AS id_a, b.id AS id_b, CAST(1.0 AS DOUBLE) AS similarity
FROM it JOIN r b ON b.label = it.label AND b.rk = (it.rk - 1 + it.iteration) % it.n + 1
UNION ALL
SELECT CAST(it.iteration AS BIGINT), it.id AS id_a, b.id AS id_b, CAST(0.0 AS DOUBLE) AS similarity
FROM it JOIN sz ON sz.label = 1 - it.label
JOIN r b ON b.label = 1 - it.label AND b.rk = (it.rk - 1 + it.iteration) % sz.n + 1""")
def contrastive_pairs(spark, sf):
    """M9: 20 iterations of positive and negative partners per labelled doc."""
    return S.contrastive_pairs(_labelled_ids(spark, sf), "id", "label", 20, SEED)


@register("confusion_matrix", O.with_(O.PREDICTIONS) + """,
d AS (SELECT label AS v FROM predictions UNION SELECT prediction FROM predictions)
SELECT a.v AS label, b.v AS prediction, CAST(count(p.doc_id) AS BIGINT) AS n
FROM d a JOIN d b ON true LEFT JOIN predictions p ON p.label = a.v AND p.prediction = b.v
GROUP BY a.v, b.v""")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(X.predictions(spark, sf))


@register("classification_report", O.with_(O.PREDICTIONS) + """,
cls AS (SELECT label AS c FROM predictions UNION SELECT prediction FROM predictions),
cnt AS (SELECT c, (SELECT count(*) FROM predictions WHERE label = c AND prediction = c) AS tp,
               (SELECT count(*) FROM predictions WHERE label = c) AS n_true,
               (SELECT count(*) FROM predictions WHERE prediction = c) AS n_pred FROM cls),
per AS (SELECT CAST(c AS VARCHAR) AS row, coalesce(tp / nullif(n_pred, 0), 0) AS precision,
               coalesce(tp / nullif(n_true, 0), 0) AS recall, CAST(n_true AS BIGINT) AS support, tp FROM cnt),
per2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM per),
tot AS (SELECT sum(support) AS n, sum(tp) AS tp, count(*) AS k, sum(precision) AS sp, sum(recall) AS sr,
               sum(f1) AS sf, sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf
        FROM per2)
SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, round(coalesce(tp / nullif(n, 0), 0), 6), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', round(sp / k, 6), round(sr / k, 6), round(sf / k, 6), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', round(coalesce(wp / nullif(n, 0), 0), 6), round(coalesce(wr / nullif(n, 0), 0), 6),
                 round(coalesce(wf / nullif(n, 0), 0), 6), CAST(n AS BIGINT) FROM tot""")
def classification_report(spark, sf):
    r = M.classification_report(X.predictions(spark, sf))
    return r.select("row", *_r(["precision", "recall", "f1"]), "support")


def _smoothed_sql(src: str, group: str = "") -> str:
    sel = f"{group}, " if group else ""
    return f"""SELECT {sel}tp / (pp + 1e-7) AS precision, tp / (pos + 1e-7) AS recall,
  2 * ((tp / (pp + 1e-7)) * (tp / (pos + 1e-7)) / ((tp / (pp + 1e-7)) + (tp / (pos + 1e-7)) + 1e-7)) AS f1
FROM (SELECT {sel}sum(round_even(least(greatest(CAST(label AS DOUBLE) * prob, 0), 1), 0)) AS tp,
             sum(round_even(least(greatest(CAST(label AS DOUBLE), 0), 1), 0)) AS pos,
             sum(round_even(least(greatest(prob, 0), 1), 0)) AS pp
      FROM {src} {'GROUP BY ' + group if group else ''})"""


@register("smoothed_f1", O.with_(O.PREDICTIONS) + f"""
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM ({_smoothed_sql('predictions')})""")
def smoothed_f1(spark, sf):
    """A10: smoothed binary metrics of probabilities."""
    return M.smoothed_f1(X.predictions(spark, sf)).select(*_r(["precision", "recall", "f1"]))


@register("batch_f1", O.with_(O.PREDICTIONS) + f"""
SELECT CAST(count(*) AS BIGINT) AS n_batches, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1
FROM ({_smoothed_sql("(SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 24 AS batch FROM predictions)", "batch")})""")
def batch_f1(spark, sf):
    """Batch-wise average over batches of 24 in document order."""
    p = X.predictions(spark, sf)
    r = M.batch_f1(p, [F.col("doc_id").asc()], range_buckets(p, "doc_id"), batch_size=24)
    return r.select(F.col("n_batches").cast("long").alias("n_batches"), *_r(["precision", "recall", "f1"]))


@register("metrics_by_group", O.with_(O.PREDICTIONS) + """
SELECT run_key, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, n FROM (
  SELECT run_key, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(pos, 0), 0) AS recall,
    coalesce(2 * (tp / nullif(pp, 0)) * (tp / nullif(pos, 0)) / nullif((tp / nullif(pp, 0)) + (tp / nullif(pos, 0)), 0), 0) AS f1,
    CAST(n AS BIGINT) AS n
  FROM (SELECT run_key, sum(CASE WHEN label = 1 AND round_even(prob, 0) = 1 THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
               sum(CASE WHEN round_even(prob, 0) = 1 THEN 1 ELSE 0 END) AS pp, count(*) AS n
        FROM predictions GROUP BY run_key))""")
def metrics_by_group(spark, sf):
    """A12 + T27: per run key, metrics of probabilities rounded to a class."""
    p = X.predictions(spark, sf).withColumn("rounded", F.rint("prob").cast("long"))
    r = M.binary_prf(p, "label", "rounded", ["run_key"])
    return r.select("run_key", *_r(["precision", "recall", "f1"]), "n")


@register("precision_at_1", O.with_(O.PREDICTIONS) + """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS precision_at_1,
       round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1
FROM predictions""")
def precision_at_1(spark, sf):
    r = M.precision_at_1(X.predictions(spark, sf))
    return r.select("n", *_r(["precision_at_1", "recall_at_1"]))


_CV_SQL = O.with_(O.CV_SCORES) + """
SELECT candidate, round(avg(score), 6) AS mean_score, round(2 * stddev_pop(score), 6) AS std2,
       CAST(count(*) AS BIGINT) AS n_folds
FROM cv_scores GROUP BY candidate"""


@register("cv_summary", _CV_SQL)
def cv_summary(spark, sf):
    r = M.cv_summary(X.cv_scores(spark, sf))
    return r.select("candidate", *_r(["mean_score", "std2"]), "n_folds")


@register("cv_best", O.with_(O.CV_SCORES) + """
SELECT candidate, round(m, 6) AS mean_score, round(s, 6) AS std2, n_folds FROM (
  SELECT candidate, avg(score) AS m, 2 * stddev_pop(score) AS s, CAST(count(*) AS BIGINT) AS n_folds
  FROM cv_scores GROUP BY candidate) ORDER BY m DESC, candidate LIMIT 1""")
def cv_best(spark, sf):
    best = M.cv_best(M.cv_summary(X.cv_scores(spark, sf)))
    return best.select("candidate", *_r(["mean_score", "std2"]), "n_folds")
