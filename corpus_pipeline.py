"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
``documents``; the last returns a row for each time a document is taken into the mixture. Between stages the table is
written under spark.checkpoint.dir and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexprep.llm import decontaminate, mixing, quality, simhash, suffix_dedup
from lexprep.llm.tables import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more)."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the smallest id."""
    return simhash.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that strings of 200 bytes cover which start elsewhere too; a character that a
    cut breaks goes too, and n_chars is that of the new text."""
    return suffix_dedup.cut_repeats(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time a document is taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
]

#: The classifier is trained and fingerprints need XXH64 of many shingles: no SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
