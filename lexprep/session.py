"""Spark session helper for tests, scripts and laptops; a cluster brings its own session."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes
# (size-checked broadcast, partition coalescing, skew-join splitting).
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Text rows are wide: keep scan splits moderate so a task holds a
    # bounded number of long documents in memory.
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "lexprep", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context: they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_lexprep_shipped", False):
        return
    top = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="lexprep-", suffix=".zip", delete=False) as held, zipfile.ZipFile(held, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.writestr(f"{top.name}/{f.relative_to(top).as_posix()}", f.read_text(encoding="utf-8"))
    sc.addPyFile(held.name)
    sc._lexprep_shipped = True


def interim_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where the setting is missing, a session of one machine takes a folder in
    its warehouse; a cluster must name one that all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/interim"
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def interim(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under spark.checkpoint.dir and read again: its lineage is cut, a lost executor costs
    a read."""
    spark = df.sparkSession
    path = interim_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
