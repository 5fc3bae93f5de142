"""Queries of the grade -> labelled-decision stage (minimum slice)."""

from __future__ import annotations

from lexprep import constants as C
from lexprep.operators import labels as L
from lexprep.plans import oracle as O
from lexprep.plans.catalog import register
from lexprep.sources import fixtures as X

_LATEST_ORACLE = O.with_(O.RESPONSES, O.LATEST) + "SELECT url, resp_id, grade FROM latest"


@register("latest_grades", _LATEST_ORACLE)
def latest_grades(spark, sf):
    return L.latest_grades(X.responses(spark, sf)).select("url", "resp_id", "grade")


@register("dedupe_counts", O.with_(O.RESPONSES) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT url) + max(CASE WHEN url IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_dedup
FROM responses""")
def dedupe_counts(spark, sf):
    return L.dedupe_counts(X.responses(spark, sf))


@register("decision_ids", O.with_(O.RESPONSES, O.LATEST, O.GRADED) + """
SELECT resp_id, url, doc_id, label FROM graded WHERE doc_id IS NOT NULL""")
def decision_ids(spark, sf):
    # parsed ids; the unparsable ones are the `rejects` query
    g = L.graded_ids(X.responses(spark, sf))
    return g.where(g.doc_id.isNotNull()).select("resp_id", "url", "doc_id", "label")


@register("rejects", O.with_(O.RESPONSES, O.LATEST, O.GRADED) + """
SELECT resp_id, url, grade FROM graded WHERE doc_id IS NULL""")
def rejects(spark, sf):
    return L.rejects(X.responses(spark, sf))


@register("labelled_set", O.with_(O.RESPONSES, O.LATEST, O.GRADED, O.DECISIONS, O.LABELLED) + """
SELECT resp_id, doc_id, grade, label, html FROM labelled""")
def labelled_set(spark, sf):
    return L.labelled_set(X.responses(spark, sf), X.decisions(spark, sf))


@register("evaluated_decisions", O.with_(O.RESPONSES, O.LATEST, O.GRADED, O.DECISIONS) + """
SELECT doc_id, corpus, html FROM decisions
WHERE doc_id IN (SELECT doc_id FROM graded WHERE doc_id IS NOT NULL)""")
def evaluated_decisions(spark, sf):
    return L.evaluated_decisions(X.responses(spark, sf), X.decisions(spark, sf))


_DOMAIN = ", ".join(f"({i}, {O.q(g)})" for i, g in enumerate(C.GRADES))


@register("grade_counts", O.with_(O.RESPONSES, O.LATEST) + f"""
SELECT CAST(d.grade_order AS BIGINT) AS grade_order, d.grade, CAST(count(l.resp_id) AS BIGINT) AS n
FROM (VALUES {_DOMAIN}) d(grade_order, grade) LEFT JOIN latest l ON l.grade = d.grade
GROUP BY d.grade_order, d.grade""")
def grade_counts(spark, sf):
    return L.grade_counts(spark, X.responses(spark, sf))


@register("class_encode", O.with_(O.PREDICTIONS) + """
SELECT doc_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS class_id FROM predictions""")
def class_encode(spark, sf):
    return L.class_encode(X.predictions(spark, sf).select("doc_id", "label")).select("doc_id", "label", "class_id")

