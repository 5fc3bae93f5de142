"""The registry must load with no jar beside pyspark and with no session."""

import os
import subprocess
import sys

from lexprep import constants as C

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_loads_without_session_or_jars():
    # a stand-in pyspark location without a jars folder: every file search there finds nothing
    code = ("import glob, zipfile\n"
            "def no_jar(*a, **k): raise AssertionError('jar access at import')\n"
            "zipfile.ZipFile = no_jar\n"
            "glob.glob = lambda *a, **k: []\n"
            "import __spark_entry__ as e\n"
            "q, o = e.queries(), e.oracle_sql()\n"
            "assert len(q) >= 54 and set(o) <= set(q)\n"
            "from pyspark import SparkContext\n"
            "assert SparkContext._active_spark_context is None\n")
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]


def test_stopword_file_equals_spark_list(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert C.spark_stopwords("portuguese") == list(StopWordsRemover.loadDefaultStopWords("portuguese"))
