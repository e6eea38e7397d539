"""Samples and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polycat.storage import Workspace


def ranked(df: DataFrame, order: list[str], *, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with its rank from 0 in a total order, without putting all rows in one task.

    Rows are range-partitioned by the order and written to the shared folder, since
    cutting them again could cut elsewhere; each partition is numbered by itself and
    starts where those before it end (a row for each partition is broadcast).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    dealt = Workspace(spark, "ranked").save(dealt, "dealt")
    numbered = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    return numbered.join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def systematic(df: DataFrame, order: list[str], stride: int, most: int, *, partitions: int | None = None) -> DataFrame:
    """Every stride-th row of an order, at most so many: a sample spread over all sizes."""
    return ranked(df, order, partitions=partitions).where((F.col("rank") % stride == 0) & (F.col("rank") < stride * most))


def largest_groups(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n largest groups, for a report."""
    return df.orderBy(F.desc(by), *ties).limit(n)
