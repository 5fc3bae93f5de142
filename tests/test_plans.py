"""Every oracle-backed query equals its DuckDB statement (sf0.001), and
the physical plans stay JVM-side with no cartesian product."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def _digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf.to_dict("records"))
    return cols, len(rows), hashlib.md5("\n".join(rows).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = _digest(QUERIES[name](spark, SF_SMALL).toPandas())
    want = _digest(duck.execute(ORACLE[name]).df())
    assert got == want


PLAN_QUERIES = ["labelled_set", "clean_text", "vocabulary_df", "tfidf", "topic_prep", "padded_sequences",
                "contrastive_pairs", "confusion_matrix", "light_prep"]


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_plan_has_no_python_and_no_cartesian(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "PythonUDF"):
        assert bad not in plan, bad


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = QUERIES["labelled_set"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # documents scan reads only what the fixture needs (not n_chars)
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan
    assert "PushedFilters: [IsNotNull(" in plan


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "text", "label"]
    assert df.count() >= 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_stream_is_counted_by_hash(spark):
    """No sort aggregate over one row per word occurrence."""
    plan = _plan(QUERIES["token_index"](spark, SF_SMALL))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_markup_is_matched_once(spark):
    from lexprep import constants as C

    for name in ("html_text", "html_text_spaced"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("<!DOCTYPE") == 1, name
    assert "<!DOCTYPE" in C.MARKUP_JAVA


def test_no_job_runs_while_a_query_is_built(spark):
    tracker = spark.sparkContext.statusTracker()
    fitted = {"doc_vectors", "classifier_features", "ngram_classifier", "ngram_precision_at_1", "grid_search", "score_test",
              "score_report", "boosting_histogram"}
    lazy = [q for q in E.catalog.QUERIES if q not in fitted]
    for name in lazy:
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        E.catalog.QUERIES[name](spark, SF_SMALL)
        jobs = tracker.getJobIdsForGroup(f"build-{name}")
        spark.sparkContext.setJobGroup("rest", "")
        # the file listing and schema of a table is a job of Spark's reader, one for each table read
        assert len(jobs) <= 4, (name, len(jobs))


def test_source_has_no_size_switch_or_local_folder():
    import pathlib

    root = pathlib.Path(E.__file__).parent / "lexprep"
    text = "".join(p.read_text(encoding="utf-8") for p in root.rglob("*.py") if "llm" not in p.parts)
    for word in ("HEAVY_LIMIT", "spread_small_input", "sized_for_training", "mkdtemp", ".checkpoint(", "broadcast("):
        assert word not in text, word
