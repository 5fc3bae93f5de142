"""The labelled training sample that the classifiers learn from, and which rows are held out."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether the row is held out; a row without an id has no remainder and is not."""
    return F.coalesce(id_remainder(id_col, modulus) == remainder, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, remainder: int,
                    max_docs: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text",
                    seed: int = 17) -> list[tuple[str, int]]:
    """Whole texts and 0/1 labels of at most ``max_docs`` documents and about ``max_bytes`` bytes: the labelled,
    not held-out ids that come first in the order of a hash. Only ids are ordered; ids and then texts that come to
    the driver have these two bounds. Rows of ``labels`` with one id count once (the larger label); null ids and
    labels are left out. Of documents with one id the greatest text stands."""
    ids = (labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
           .where(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out("i", modulus, remainder))
           .groupBy("i").agg(F.max("y").alias("y"))
           .orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(max_docs))
    picked = ids.collect()
    if not picked:
        return []
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(r["i"], r["y"]) for r in picked], ids.schema))
    rows = (docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
            .join(chosen, "i").groupBy("i", "y").agg(F.max("t").alias("t"))
            .withColumn("b", F.octet_length("t")).persist(StorageLevel.MEMORY_AND_DISK))
    size = {r["i"]: r["b"] for r in rows.select("i", "b").collect()}
    keep, total = [], 0
    for r in picked:  # in hash order
        if r["i"] in size and (not keep or total + size[r["i"]] <= max_bytes):
            keep.append(r["i"])
            total += size[r["i"]]
    last = F.broadcast(spark.createDataFrame([(k, n) for n, k in enumerate(keep)], f"i {ids.schema['i'].dataType.simpleString()}, n int"))
    out = rows.join(last, "i").select("n", "t", "y").collect()
    rows.unpersist()
    return [(r["t"], r["y"]) for r in sorted(out, key=lambda r: r["n"])]
