"""Sources and sinks.

Reads declare only the columns they need, so Catalyst prunes the Parquet
scan (ReadSchema) and pushes ``IsNotNull`` filters into it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexprep import constants as C

# spaces and ':' in these names need backticks
URL_HEADER, GRADE_HEADER, BLOG_HEADER = C.URL_HEADER, C.GRADE_HEADER, C.BLOG_HEADER

GRADES_SCHEMA = T.StructType([
    T.StructField(URL_HEADER, T.StringType(), True),
    T.StructField(GRADE_HEADER, T.StringType(), True),
    T.StructField(BLOG_HEADER, T.StringType(), True),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_grades_csv(spark: SparkSession, path: str, order_col: str = "resp_id") -> DataFrame:
    """Survey CSV (quoted newlines allowed) -> (resp_id, url, grade, blog).

    Keep-last needs the order of the answers: files by name, rows by place.
    Spark packs files into tasks by size, so the file's rank by name (one row
    per file) makes the high part of ``resp_id`` and the place in the file the
    low one. A multi-line CSV file is read by one task; a survey too large
    for that should come as Parquet with an order column of its own.
    """
    raw = (spark.read.schema(GRADES_SCHEMA)
           .option("header", True).option("multiLine", True).option("escape", '"')
           .csv(path))
    rows = raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
        F.col(f"`{URL_HEADER}`").alias("url"),
        F.col(f"`{GRADE_HEADER}`").alias("grade"),
        F.col(f"`{BLOG_HEADER}`").alias("blog"),
    )
    files = rows.select("_file").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_file")))
    return rows.join(files, "_file").select(
        (F.shiftleft((F.col("_rank") - 1).cast("long"), 33) + F.col("_place")).alias(order_col), "url", "grade", "blog")


def read_decisions(spark: SparkSession, path: str, id_col: str = "idJurisprudencia",
                   html_col: str = "html") -> DataFrame:
    """S2 + P1: decisions with a document; the null filter reaches the scan."""
    return (spark.read.parquet(path)
            .select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).alias("html"))
            .where(F.col("html").isNotNull()))


def read_corpora(spark: SparkSession, paths: dict[str, str], html_col: str = "html") -> DataFrame:
    """S3 + P1: several named Parquet corpora as one (corpus, doc_id, html).

    The id is the document's place in one reading of the files: it keeps
    documents distinct within a job and is no key between jobs.
    """
    frames = [
        spark.read.parquet(p).where(F.col(html_col).isNotNull())
        .select(F.lit(name).alias("corpus"), F.monotonically_increasing_id().alias("doc_id"),
                F.col(html_col).alias("html"))
        for name, p in paths.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_text_corpus(df: DataFrame, path: str, text_col: str = "text", order_cols: list[str] | None = None) -> None:
    """One cleaned document per line, parallel part files; with
    ``order_cols`` the part files, read by name, hold them in that order."""
    if order_cols:
        df = df.orderBy(*order_cols)
    df.select(F.regexp_replace(text_col, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def labelled_line(label_col: str = "label_str", text_col: str = "text"):
    """S5 line: ``label document`` with line breaks and tabs folded to a space."""
    return F.concat_ws(" ", F.col(label_col), F.regexp_replace(F.col(text_col), r"[\t\r\n]+", " "))


def write_labelled_lines(df: DataFrame, path: str, label_col: str = "label_str", text_col: str = "text") -> None:
    df.select(labelled_line(label_col, text_col).alias("value")).write.mode("overwrite").text(path)
