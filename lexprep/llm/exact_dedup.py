"""Exact dedup by a persistent digest index.

The index is a Parquet table, bucketed and sorted by the SHA-256 digest of a text and partitioned by the batch that
brought the text first. New rows are reduced to one row per digest before they are shuffled, met with the index by a
sort-merge anti-join that leaves the index where it is (it has its buckets), and what is new is appended as the
batch's own partition. A batch that is taken in again, after a lost driver say, overwrites its own partition and is
judged against the other batches only, so its answer is the same.

Of the rows of a batch with one text that no earlier batch had, the one with the largest id stays. A text that an
earlier batch had loses all its rows. A digest that very many rows share is one row after the partial sums; on the
way back such digests, at most ``HEAVY`` by their share, are broadcast and the rest is joined by shuffle, so no task
gets a whole group.

Null texts count as empty; empty texts are equal to each other. Very long texts are one digest like any other. Null
ids come before all others: a null id stays only in a group without any other. Rows that repeat both id and text are
one document: each is marked alike and counts in ``group_size``, and ``new_documents`` returns one of them. An empty
table gives an empty result and an empty partition. Columns besides id and text are not looked at, whatever their
names; ``new_documents`` gives them back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexprep.llm import arrow as A
from lexprep.llm.tables import quoted, written

#: A digest with more than this share of a batch's rows is broadcast on the way back; there are at most so many.
HEAVY = 1024


@dataclass(frozen=True)
class Index:
    """An index on disk: its table in the session's catalog, the folder, and the number of its buckets."""

    spark: SparkSession
    table: str
    path: str
    buckets: int

    def rows(self) -> DataFrame:
        """(digest, keep_id, n, batch): each text once, under the batch that brought it."""
        return self.spark.table(self.table)


def open_index(spark: SparkSession, path: str, buckets: int = 64, id_type: T.DataType = T.LongType()) -> Index:
    """The index in this folder, or a new one. Buckets and id type of an index that exists are those it was made with.

    The catalog entry is made anew in each session, so no metastore is needed; the data lies in ``path`` alone."""
    about = T.StructType([T.StructField("buckets", T.IntegerType()), T.StructField("id_type", T.StringType())])
    try:
        made = spark.read.schema(about).parquet(f"{path}/about").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        made = None
    if made is None:
        made = T.Row(buckets=buckets, id_type=id_type.simpleString())
        spark.createDataFrame([made], about).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    table = f"digest_index_{hashlib.md5(path.encode()).hexdigest()[:16]}"
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id {made['id_type']}, n BIGINT, batch STRING)
        USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {made['buckets']} BUCKETS
        LOCATION '{path}/digests'""")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/digests")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    spark.catalog.recoverPartitions(table)
    return Index(spark, table, path, made["buckets"])


def digest(text_col: str, normal: Callable[[Column], Column] | None = None) -> Column:
    """SHA-256 of the text in UTF-8, after ``normal`` if there is one."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    return F.unhex(F.sha2((normal(text) if normal else text).cast("binary"), 256))


def unseen(groups: DataFrame, index: Index, batch: str) -> DataFrame:
    """The digests that no other batch has. The index keeps its buckets; the few columns of the groups move to them."""
    old = index.rows().where(F.col("batch") != batch).select("digest")
    return groups.repartition(index.buckets, "digest").join(old.hint("merge"), "digest", "left_anti")


def put(rows: DataFrame, index: Index, batch: str) -> None:
    """Write rows (digest, keep_id, n) as the batch's partition, one sorted file per bucket, in place of what it had."""
    index.spark.sql(f"INSERT OVERWRITE TABLE {index.table} PARTITION (batch = :batch) SELECT digest, keep_id, n FROM {{rows}}",
                    {"batch": batch}, rows=rows.repartition(index.buckets, "digest"))


def ingest(docs: DataFrame, index: Index, batch: str, id_col: str = "doc_id", text_col: str = "text",
           normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """Take a batch in. A row for each row of ``docs``: id, digest, keep_id (the id that stands for the text),
    group_size (rows of the batch with that text), known (an earlier batch had it), kept."""
    rows = written(docs.select(F.col(quoted(id_col)).alias("id"), digest(text_col, normal).alias("digest")), "digests")
    groups = written(rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "groups")
    put(written(unseen(groups, index, batch), "unseen"), index, batch)
    stands = index.rows().select("digest", F.col("keep_id").alias("first_id"), (F.col("batch") != batch).alias("known"))
    answer = written(groups.select("digest", F.col("n").alias("group_size")).repartition(index.buckets, "digest")
                     .join(stands.hint("merge"), "digest"), "answer")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    heavy = answer.where(F.col("group_size") > F.lit(total) / HEAVY)  # fewer than HEAVY rows
    light = answer.where(F.col("group_size") <= F.lit(total) / HEAVY)
    often = F.broadcast(heavy)
    met = rows.join(often, "digest").unionByName(
        rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest"))
    return met.select("id", "digest", F.col("first_id").alias("keep_id"), "group_size", "known",
                      (~F.col("known") & F.col("id").eqNullSafe(F.col("first_id"))).alias("kept"))


def new_documents(docs: DataFrame, index: Index, batch: str, id_col: str = "doc_id", text_col: str = "text",
                  normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """Of a batch that has been taken in, the documents that stay, with all their columns: one for each text that the
    batch brought first."""
    mark = A.free_name(docs, "digest_of_text")
    first = index.rows().where(F.col("batch") == batch).select(F.col("digest").alias("d_"), F.col("keep_id").alias("k_"))
    rows = docs.withColumn(mark, digest(text_col, normal))
    stays = rows.join(first, rows[quoted(mark)].eqNullSafe(first["d_"]) & rows[quoted(id_col)].eqNullSafe(first["k_"]), "left_semi")
    return stays.dropDuplicates([mark]).drop(mark)


def compact(index: Index, path: str, buckets: int | None = None) -> Index:
    """The same index in a new folder, all its batches as one partition with one file per bucket (and, if wished,
    another number of buckets). Which batch brought a text is forgotten: batches taken in before must not come again."""
    kind = index.rows().schema["keep_id"].dataType
    fresh = open_index(index.spark, path, buckets or index.buckets, kind)
    put(index.rows(), fresh, "compacted")
    return fresh
