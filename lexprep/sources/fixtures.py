"""Derived inputs: the given test tables reshaped into the pipeline's inputs.

The test tables hold no grade survey, no court HTML and no model output,
so these views derive them (whole tables, every row) with fixed rules; the
oracle restates the same rules in SQL (plans/oracle.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexprep import constants as C
from lexprep.sources.readers import table

_GRADE_BY_EVENT = {"signup": 0, "view": 1, "click": 2, "purchase": 3}


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resp_id, url, grade): several answers per URL, null URLs and grades,
    URLs whose id cannot be parsed. resp_id is the file order."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    uid = F.col("user_id")
    url = (F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("string"))
           .when(uid % 5 == 0, F.concat(F.lit(C.URL_STRIP_CHARS), uid.cast("string"), F.lit("/agravo")))
           .when(uid % 11 == 0, F.concat(F.lit("https://tj-sp.jusbrasil.com.br/processos/"), uid.cast("string")))
           .otherwise(F.concat(F.lit(C.URL_STRIP_CHARS), (uid + 100000).cast("string"),
                               F.lit("/inteiro-teor-"), uid.cast("string"))))
    grade = F.when(F.col("event_id") % 101 == 0, F.lit(None).cast("string"))
    for ev_type, g in _GRADE_BY_EVENT.items():
        grade = grade.when(F.col("event_type") == ev_type, F.lit(C.GRADES[g]))
    grade = grade.otherwise(F.lit(C.GRADES[4]))
    return ev.select(F.col("event_id").alias("resp_id"), url.alias("url"), grade.alias("grade"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, corpus, html): court-style HTML with party lines, a table
    row, law mentions, absolute and relative links, and null documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    i = F.col("doc_id")
    ids = i.cast("string")
    body = F.concat(
        F.lit("<p>RECORRENTE: "), F.col("source"), F.lit("</p><table><tr>ADVOGADO "), F.col("lang"),
        F.lit("</tr></table><p>"), F.col("text"), F.lit("</p>"),
        F.when(i % 3 == 0, F.lit("<p>Lei 13.709/2018 (LGPD), Lei Geral de Proteção de Dados</p>")).otherwise(F.lit("")),
        F.when(i % 4 == 0, F.concat(F.lit('<a href="http://www.jusbrasil.com.br/topicos/'), ids, F.lit("/artigo-"), ids,
                                    F.lit('-lei" title="Artigo '), ids, F.lit('">ver</a>')))
        .when(i % 4 == 1, F.lit('<a href="/outro">ver</a>')).otherwise(F.lit("")),
    )
    html = F.when(i % 50 == 49, F.lit(None).cast("string")).otherwise(body)
    return d.select(i.alias("doc_id"), F.col("lang").alias("corpus"), html.alias("html"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, run_key, label, prediction, prob): a fixed rule stands in
    for a model so the metrics have an exact oracle."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("source").alias("run_key"), F.col("quality").cast("long").alias("label"),
        F.when(F.col("n_chars") % 3 == 0, 0).otherwise(1).cast("long").alias("prediction"),
        ((F.col("n_chars") % 101).cast("double") / 100).alias("prob"),
    )


def cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate, fold, score): candidate x fold scores of a search."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return e.select(F.col("label").cast("long").alias("candidate"), (F.col("vec_id") % 5).alias("fold"),
                    ((F.col("vec_id") * 7919) % 1000).cast("double").__truediv__(1000).alias("score"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ents): all capitalised words of each document, standing in
    for a person recogniser's output, in order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), 0).alias("ents"))
