"""Listing and reading shards through Hadoop's file systems, so that any store that Spark reads works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polycat.schema import resolve_input

#: Rows that one file may have below: a row's index is the file's place times this, plus its place in the file.
FILE_STRIDE = 1 << 40


def hadoop(spark: SparkSession, path: str):
    """The file system that holds a path, and the path, as Hadoop sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def list_files(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """The folder's files with a suffix, by name; an empty folder is an error, and empty files are left out."""
    system, path = hadoop(spark, folder)
    if system.getFileStatus(path).isFile():
        return [folder]
    found = [s for s in system.listStatus(path) if s.isFile() and s.getPath().getName().endswith(suffix) and s.getLen() > 0]
    names = sorted(s.getPath().getName() for s in found)
    if not names:
        raise FileNotFoundError(f"{folder} has no {suffix} files")
    return [f"{folder.rstrip('/')}/{n}" for n in names]


def sound_files(spark: SparkSession, folder: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The folder's files that end as Parquet files do, and the others with what is wrong with each."""
    from polycat.sources.rowgroups import check_files

    found = {r.file: r.problem for r in check_files(spark, list_files(spark, folder)).select("file", "problem").collect()}
    return sorted(f for f in found if found[f] is None), sorted((f, p) for f, p in found.items() if p is not None)


def file_range(files: list[str], start: int = 0, end: int | None = None) -> list[str]:
    """The files from ``start`` to ``end``, both included; ``end`` may lie beyond the last, ``start`` may not."""
    if not 0 <= start < len(files):
        raise ValueError(f"file {start} of {len(files)} asked for")
    if end is not None and end < start:
        raise ValueError("the last file comes before the first")
    return files[start : len(files) if end is None else min(end, len(files) - 1) + 1]


def read_weights(spark: SparkSession, folder: str, *, start: int = 0, end: int | None = None, max_rows: int | None = None, only: list[str] | None = None) -> DataFrame:
    """Weight rows of a range of a folder's files (of those, ``only`` some names), resolved, at most ``max_rows`` of each file.

    ``source_index`` is the input's, or the file's place in the folder and the row's
    in the file: unique over all files, whatever range is read.
    """
    files = list_files(spark, folder)
    chosen = [f for f in file_range(files, start, end) if only is None or f.rsplit("/", 1)[-1] in set(only)]
    df = spark.read.parquet(*chosen)
    names = F.array(*(F.lit(f.rsplit("/", 1)[-1]) for f in files))
    place = F.array_position(names, F.col("_metadata.file_name")) - 1
    numbered = df.withColumn("_row", F.col("_metadata.row_index")).withColumn("_index", place * FILE_STRIDE + F.col("_row"))
    if max_rows is not None:
        numbered = numbered.where(F.col("_row") < max_rows)
    return resolve_input(numbered, index="_index")


def first_rows(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """A benchmark's input: the first file's first n rows."""
    return read_weights(spark, folder, start=0, end=0, max_rows=n)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its scan has fewer partitions than there are.

    A file of one row group is read by one task, and all expressions on its rows
    would run there too.  Tables of many files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def by_position(df: DataFrame, positions: DataFrame, *, file: str = "file_name", row: str = "row_index") -> DataFrame:
    """Only the rows at the given places; heavy columns are read for these alone."""
    placed = df.withColumn("file_name", F.col("_metadata.file_name")).withColumn("row_index", F.col("_metadata.row_index"))
    return placed.join(positions.select(F.col(file).alias("file_name"), F.col(row).alias("row_index")), ["file_name", "row_index"], "left_semi")


def shard_range(files: Column, shards: Column, shard: Column) -> tuple[Column, Column]:
    """``shard_ranges`` of one shard as columns ``first`` and ``last``; an empty shard's last file is before its first."""
    each, more = F.floor(files / shards), files % shards
    first = shard * each + F.least(shard, more)
    return first.cast("bigint").alias("first"), (first + each + F.when(shard < more, 1).otherwise(0) - 1).cast("bigint").alias("last")


def shard_ranges(files: int, shards: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of files for each shard; the first shards get one more where it doesn't divide; empty shards are left out."""
    each, more = divmod(files, shards)
    out, at = [], 0
    for k in range(shards):
        n = each + (k < more)
        if n:
            out.append((at, at + n - 1))
        at += n
    return out
