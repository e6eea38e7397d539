"""Adding columns to catalogues: recomputed normal forms, and columns computed elsewhere, by position."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polycat.operators.classify import classify
from polycat.schema import resolve_catalogue


def packed(flat: list[int]) -> bytes:
    """A normal form as little-endian 32-bit integers, row by row; an entry that doesn't fit is an error."""
    try:
        return struct.pack(f"<{len(flat)}i", *flat)
    except struct.error:
        raise OverflowError("a normal form has an entry of more than 32 bits") from None


def unpacked(blob: bytes) -> list[list[int]]:
    """The 5 rows of a packed normal form."""
    flat = struct.unpack(f"<{len(blob) // 4}i", blob)
    width = len(flat) // 5
    return [list(flat[k * width : (k + 1) * width]) for k in range(5)]


def add_normal_forms(table: DataFrame, *, verify: bool = True) -> DataFrame:
    """``table`` with ``nf_vertices`` (null where the kernel fails) and, on request, ``key_matches``.

    ``key_matches`` compares the recomputed key with ``nf_key`` and is null where the
    table has none.  All columns stay.
    """
    kept = table.columns
    rows = table.select(F.struct(*kept).alias("_kept"), resolve_catalogue(table).alias("rows"))
    tried = classify(rows.withColumn("degrees", F.transform("rows", lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda a, x: a + x))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([packed(x) if x else None for x in flat], pa.binary())], names=["_kept", "_key", "nf_vertices"])

    fields = T.StructType([T.StructField("_kept", rows.schema["_kept"].dataType), T.StructField("_key", T.BinaryType()), T.StructField("nf_vertices", T.BinaryType())])
    out = tried.select("_kept", "nf", "nf_key").mapInArrow(pack, fields)
    columns = [F.col(f"_kept.`{c}`").alias(c) for c in kept] + [F.col("nf_vertices")]
    if verify and "nf_key" in kept:
        columns.append((F.col("_key") == F.col("_kept.nf_key")).alias("key_matches"))
    return out.select(*columns)


POSITION = ["source_row_group", "source_row_in_group"]


def positional_merge(left: DataFrame, right: DataFrame, *, drop: tuple = (), rename: dict | None = None, last: tuple = ("count",)) -> DataFrame:
    """Two tables side by side by (row group, row in group); columns of ``right`` replace those of ``left`` after renaming.

    ``last`` columns come last.  Whether positions match one to one is for
    ``positional_audit`` to say; here unmatched rows are an error.
    """
    rename = rename or {}
    right = right.select(*POSITION, *(F.col(c).alias(rename.get(c, c)) for c in right.columns if c not in POSITION))
    own = [c for c in left.columns if c not in POSITION and c not in drop and c not in right.columns]
    new = [c for c in right.columns if c not in POSITION]
    one, two = left.withColumn("_left", F.lit(True)), right.withColumn("_right", F.lit(True))
    both = one.select(*POSITION, "_left", *own).join(two, POSITION, "full_outer")
    matched = F.when(F.col("_left").isNotNull() & F.col("_right").isNotNull(), F.col(POSITION[0])).otherwise(F.raise_error(F.lit("the tables don't match by position")).cast(left.schema[POSITION[0]].dataType))
    order = [c for c in own + new if c not in last] + [c for c in last if c in own + new]
    return both.select(matched.alias(POSITION[0]), POSITION[1], *order)


def aligned_merge(spark: SparkSession, left: list[str], right: list[str], *, drop: tuple = (), rename: dict | None = None, last: tuple = ("count",), rows: int | None = None) -> DataFrame:
    """``positional_merge`` of two lists of files whose rows stand in the same order: no shuffle, each task reads some row groups of both.

    Positions are compared row by row; a difference, or another number of files or rows, is an error.
    """
    from polycat.sources import rowgroups  # Parquet and file systems of Arrow, which a driver without this step needn't hold

    rename = rename or {}
    one, two = (rowgroups.parquet_file(side[0]).schema_arrow.names for side in (left, right))
    new = {rename.get(c, c): (1, c) for c in two if c not in POSITION}
    own = {c: (0, c) for c in one if c not in POSITION and c not in drop and c not in new}
    from_ = own | new
    order = [c for c in from_ if c not in last] + [c for c in last if c in from_]
    columns = [(0, c, c) for c in POSITION] + [(*from_[c], c) for c in order]
    return rowgroups.aligned(spark, left, right, columns, same=POSITION, rows=rows or rowgroups.PARTITION)


def same_rows(left: list[str], right: list[str]) -> bool:
    """Whether two lists of files have the same positions file by file, by the first and last of each row range: footers and statistics, no data."""
    from polycat.sources import rowgroups

    if len(left) != len(right) or [sum(n) for n in rowgroups.footers(left)] != [sum(n) for n in rowgroups.footers(right)]:
        return False
    return all(rowgroups.ranges(x, POSITION) == rowgroups.ranges(y, POSITION) for x, y in zip(left, right, strict=True))


def positional_audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows of either side, positions that only one has, repeated positions, and whether they match one to one."""
    sides = left.select(*POSITION, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*POSITION, F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = sides.groupBy(*POSITION).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    zero = F.lit(0)
    out = each.agg(
        F.coalesce(F.sum("l"), zero).cast("bigint").alias("left_rows"),
        F.coalesce(F.sum("r"), zero).cast("bigint").alias("right_rows"),
        F.count_if(F.col("r") == 0).cast("bigint").alias("left_only"),
        F.count_if(F.col("l") == 0).cast("bigint").alias("right_only"),
        F.count_if((F.col("l") > 1) | (F.col("r") > 1)).cast("bigint").alias("repeated"),
    )
    return out.withColumn("aligned", (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("repeated") == 0))
