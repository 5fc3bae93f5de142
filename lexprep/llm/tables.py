"""Interim tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexprep.llm.components import use_checkpoint_dir


def quoted(name: str) -> str:
    """A column name as a path of one part, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder name of its own under spark.checkpoint.dir."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as Parquet under spark.checkpoint.dir and read again: its lineage is cut, a lost executor
    costs a read, and hashes take their eight bytes. ``options`` are those of the writer."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
