"""Cleaning on a stream of documents.

The original pipeline has no stream, window or state. The cleaning
operators are stateless column expressions, so they run unchanged on a
streaming DataFrame: new Parquet files of HTML are cleaned as they land.
The vocabulary step is corpus-wide and stays batch-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexprep.operators import cleaning as K
from lexprep.options import CleanOptions


def cleaned_stream(spark: SparkSession, source_dir: str, schema: T.StructType, id_col: str, html_col: str,
                   glob: str = "*.parquet", opts: CleanOptions = CleanOptions(),
                   max_files_per_trigger: int = 100) -> DataFrame:
    """readStream over Parquet files -> (id, text), null documents dropped."""
    src = (spark.readStream.schema(schema).option("pathGlobFilter", glob)
           .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    return src.where(F.col(html_col).isNotNull()).select(id_col, K.clean_text(html_col, opts).alias("text"))


def write_cleaned(stream: DataFrame, sink_dir: str, checkpoint_location: str, available_now: bool = True):
    """Append cleaned rows to Parquet; the checkpoint makes restarts exactly-once."""
    w = stream.writeStream.format("parquet").option("path", sink_dir) \
        .option("checkpointLocation", checkpoint_location).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
