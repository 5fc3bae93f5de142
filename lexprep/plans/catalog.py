"""Registered queries: name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or None).

Each query reads the whole test tables (through the derived inputs of
sources/fixtures.py) so its work grows with the scale factor. Floating
results are rounded to 6 places on both sides; arrays are emitted as
joined strings so both engines hash them alike.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    # importing the plan modules fills the registry
    for mod in ("q_labels", "q_text", "q_html", "q_corpus", "q_features", "q_metrics", "q_models"):
        importlib.import_module(f"lexprep.plans.{mod}")
