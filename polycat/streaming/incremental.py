"""A catalogue that follows a folder of weight files by Structured Streaming.

Each micro-batch classifies its new rows and writes a partial catalogue named
after the batch, so a batch that is run again replaces itself; readers merge the
partial catalogues.  ``compact`` merges them into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from polycat.operators.catalogue import catalogue, merge
from polycat.schema import resolve_input


def follow(spark: SparkSession, folder: str, schema: T.StructType, runs: str, checkpoint: str, *, files_per_batch: int = 100) -> StreamingQuery:
    """Start a query that keeps the partial catalogues in ``runs`` up to date; the stream's own checkpoint knows the files that were read."""

    def write(batch: DataFrame, number: int) -> None:
        numbered = batch if "source_index" in batch.columns else batch.withColumn("_index", F.monotonically_increasing_id() + F.lit(number) * F.lit(1 << 50))
        catalogue(resolve_input(numbered, index="_index")).write.mode("overwrite").parquet(f"{runs}/batch={number:09d}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, runs: str) -> DataFrame:
    """The catalogue that the partial ones make together."""
    return merge(spark.read.parquet(runs).drop("batch"))


def compact(spark: SparkSession, runs: str, path: str) -> DataFrame:
    """The merged catalogue, written to a path of its own."""
    current(spark, runs).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
