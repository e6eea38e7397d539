"""A catalogue in buckets of keys, of which a new run rewrites only those that it touches.

Every run is kept as it came, by run and bucket; the catalogue's buckets are made
from the runs.  Adding a run writes it, finds its buckets and makes those anew
from what all runs have of them; all other buckets are neither read nor written.
Writing a run again replaces it, and a bucket is never made from itself, so a
crash at any point is mended by adding the same run again: nothing is counted twice
and nothing gets lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polycat.operators.catalogue import merge

KEEP = {"compression": "zstd"}


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a text or binary key, by its MD5."""
    return F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 6), 16, 10).cast("int") % buckets


def _placed(df: DataFrame, key: str) -> DataFrame:
    """Each bucket in one task, sorted by key; Spark cuts one that is large into several and puts small ones together."""
    return df.hint("rebalance", "bucket").sortWithinPartitions("bucket", key)


def add_run(run: DataFrame, folder: str, tag: str, *, key: str = "nf_key", buckets: int = 64) -> dict:
    """Add a partial catalogue, and make the buckets anew that it touches; returns its ``keys``, and how many buckets were ``touched``.

    ``run`` has ``key``, ``count``, ``source_index`` and any payload, as all runs of the
    folder do.  ``tag`` names it.  Number of buckets and payload must stay the same over
    all runs.  The driver gets the numbers of the buckets.  One writer at a time.
    """
    spark = run.sparkSession
    named = run.withColumn("bucket", bucket_of(key, buckets))
    path = f"{folder}/runs/run={tag}"
    _placed(named, key).write.partitionBy("bucket").mode("overwrite").options(**KEEP).parquet(path)
    wrote = {r["bucket"]: r["count"] for r in spark.read.schema(named.schema).parquet(path).groupBy("bucket").count().collect()}
    if not wrote:
        return {"keys": 0, "touched": 0}
    have = spark.read.schema(named.schema).option("basePath", path.rsplit("/", 1)[0]).parquet(*(f"{folder}/runs/run=*/bucket={b}" for b in sorted(wrote))).drop("run")
    whole = merge(have, key=["bucket", key])
    _placed(whole, key).write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**KEEP).parquet(f"{folder}/catalogue")
    return {"keys": sum(wrote.values()), "touched": len(wrote)}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue, with ``bucket``."""
    return spark.read.parquet(f"{folder}/catalogue")
