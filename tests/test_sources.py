"""Sources and sinks: survey CSV, Parquet corpora, text and labelled-line files."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lexprep.operators import labels as L
from lexprep.sources import readers as R


def test_grades_csv_round_trip_keeps_file_order(spark):
    d = tempfile.mkdtemp(prefix="lexprep-csv-")
    path = os.path.join(d, "responses.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('"Url:","Pertinência do debate sobre a LGPD:","Decisão merece artigo ou texto no blog:"\n')
        f.write('"https://www.jusbrasil.com.br/jurisprudencia/1/agravo","0 - não é decisão judicial","Não"\n')
        f.write('"https://www.jusbrasil.com.br/jurisprudencia/1/agravo","4 - a LGPD é a questão central do caso",'
                '"Sim, com\nquebra de linha"\n')
        f.write(',"3 - debate incidental sobre a LGPD",\n')
    g = R.read_grades_csv(spark, path)
    rows = g.orderBy("resp_id").collect()
    assert [r.grade[0] for r in rows] == ["0", "4", "3"]
    assert rows[1].blog == "Sim, com\nquebra de linha"
    last = L.graded_ids(g).collect()
    assert [(r.doc_id, r.label) for r in last] == [(1, 1)]


def test_read_corpora_drops_null_documents(spark):
    d = tempfile.mkdtemp(prefix="lexprep-corpora-")
    a, b = os.path.join(d, "a"), os.path.join(d, "b")
    spark.createDataFrame([(1, "<p>x</p>"), (2, None)], "idJurisprudencia long, html string").write.parquet(a)
    spark.createDataFrame([(7, "<p>y</p>")], "idJurisprudencia long, html string").write.parquet(b)
    u = R.read_corpora(spark, {"a": a, "b": b})
    assert sorted((r.corpus, r.html) for r in u.collect()) == [("a", "<p>x</p>"), ("b", "<p>y</p>")]
    dec = R.read_decisions(spark, a)
    plan = dec._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(html)]" in plan


def test_text_and_labelled_line_sinks(spark):
    d = tempfile.mkdtemp(prefix="lexprep-sink-")
    df = spark.createDataFrame([("__label__positive", "a b\nc"), ("__label__negative", "d\te")],
                               "label_str string, text string")
    R.write_text_corpus(df, os.path.join(d, "corpus"))
    R.write_labelled_lines(df, os.path.join(d, "lines"))
    corpus = sorted(r.value for r in spark.read.text(os.path.join(d, "corpus")).collect())
    lines = sorted(r.value for r in spark.read.text(os.path.join(d, "lines")).collect())
    assert corpus == ["a b c", "d\te"]
    assert lines == ["__label__negative d e", "__label__positive a b c"]


def test_grades_csv_of_several_files_in_name_order(spark):
    d = tempfile.mkdtemp(prefix="lexprep-csv2-")
    url = "https://www.jusbrasil.com.br/jurisprudencia/1/agravo"
    head = '"Url:","Pertinência do debate sobre a LGPD:","Decisão merece artigo ou texto no blog:"\n'
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8") as f:
        f.write(head + f'"{url}","0 - não é decisão judicial","Não"\n')
    with open(os.path.join(d, "b.csv"), "w", encoding="utf-8") as f:  # the larger file, read first by Spark
        f.write(head + '"https://x/2/z","1 - não tem relação com a LGPD","Não"\n' * 500)
        f.write(f'"{url}","4 - a LGPD é a questão central do caso","Sim"\n')
    g = R.read_grades_csv(spark, d)
    assert g.select("resp_id").distinct().count() == g.count() == 502
    assert {r.grade[0] for r in L.latest_grades(g).where(F.col("url") == url).collect()} == {"4"}


def test_text_corpus_keeps_an_order(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="lexprep-order-"), "corpus")
    df = spark.createDataFrame([(i, f"doc {i:04d}") for i in range(500)], "id long, text string").repartition(7)
    R.write_text_corpus(df, path, order_cols=["id"])
    lines = []
    for f in sorted(x for x in os.listdir(path) if x.startswith("part-")):
        with open(os.path.join(path, f), encoding="utf-8") as h:
            lines += h.read().splitlines()
    assert lines == [f"doc {i:04d}" for i in range(500)]
