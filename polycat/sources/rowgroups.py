"""Parquet by place: aligned tables side by side without a shuffle, and rows by number from the row groups that have them.

Footers say how many rows each row group has, so the place of every row is known
before anything is read.  Two data sources plan their partitions from that; each
task reads row groups of its own with Arrow, from any store that Arrow's file systems
reach (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: Rows that a task hands over at a time, and rows of a partition, about: whole row groups, one at least.
BATCH, PARTITION = 1 << 16, 1 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file://") else path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def parquet_file(path: str) -> pq.ParquetFile:
    store, at = _open(path)
    return pq.ParquetFile(store.open_input_file(at))


def footers(paths: list[str]) -> list[list[int]]:
    """The rows of each row group of each file."""

    def rows(path: str) -> list[int]:
        meta = parquet_file(path).metadata
        return [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(rows, paths))


def ranges(path: str, columns: list[str]) -> list[tuple]:
    """The least and the greatest value of some columns of a file, from the footer's statistics; None where there are none."""
    meta = parquet_file(path).metadata
    names = [meta.schema.column(k).path for k in range(meta.num_columns)]
    out = []
    for c in columns:
        found = [meta.row_group(k).column(names.index(c)).statistics for k in range(meta.num_row_groups) if meta.row_group(k).num_rows]
        known = found and all(s is not None and s.has_min_max for s in found)
        out.append((min(s.min for s in found), max(s.max for s in found)) if known else None)
    return out


def _cuts(groups: list[int], least: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``least`` rows or more that begin and end with row groups."""
    out, at, begin = [], 0, 0
    for n in groups:
        at += n
        if at - begin >= least:
            out.append((begin, at))
            begin = at
    return out + ([(begin, at)] if at > begin else [])


def rows_of(path: str, groups: list[int], first: int, last: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows ``first`` up to ``last`` of a file, from the row groups that have them alone."""
    ends = np.cumsum(groups)
    some = [k for k in range(len(groups)) if ends[k] > first and ends[k] - groups[k] < last]
    at = int(ends[some[0]] - groups[some[0]]) if some else 0
    for batch in parquet_file(path).iter_batches(BATCH, row_groups=some, columns=columns):
        lo, hi = max(first - at, 0), min(last - at, batch.num_rows)
        if lo < hi:
            yield batch.slice(lo, hi - lo)
        at += batch.num_rows


class _Pair(InputPartition):
    def __init__(self, left: str, right: str, groups: tuple, rows: tuple[int, int]):
        self.left, self.right, self.groups, self.rows = left, right, groups, rows


class AlignedTables(DataSource):
    """Two lists of files whose rows are the same in number and order, as one table: ``left`` and ``right`` (JSON lists of paths),
    ``columns`` (JSON: side 0 or 1, its column, and the name here) and ``same`` (JSON: columns that must be equal on both sides, checked in each row)."""

    @classmethod
    def name(cls) -> str:
        return "aligned_tables"

    def schema(self):
        sides = [from_arrow_schema(parquet_file(json.loads(self.options[s])[0]).schema_arrow) for s in ("left", "right")]
        out = []
        for side, column, name in json.loads(self.options["columns"]):
            field = sides[side][column]
            out.append((name, field.dataType))
        from pyspark.sql.types import StructField, StructType

        return StructType([StructField(n, t) for n, t in out])

    def reader(self, schema) -> DataSourceReader:
        return _AlignedReader(self.options, schema)


class _AlignedReader(DataSourceReader):
    def __init__(self, options, schema):
        self.left, self.right, self.columns, self.same = (json.loads(options[k]) for k in ("left", "right", "columns", "same"))
        self.least = int(options.get("rows", PARTITION))
        self.kind = to_arrow_schema(schema)

    def partitions(self) -> list[_Pair]:
        if len(self.left) != len(self.right):
            raise ValueError(f"{len(self.left)} files and {len(self.right)} aren't aligned")
        out = []
        for left, right, one, two in zip(self.left, self.right, footers(self.left), footers(self.right), strict=True):
            if sum(one) != sum(two):
                raise ValueError(f"{left} has {sum(one)} rows, {right} {sum(two)}")
            out += [_Pair(left, right, (one, two), cut) for cut in _cuts(one, self.least)]
        return out or [_Pair("", "", ([], []), (0, 0))]

    def read(self, part: _Pair) -> Iterator[pa.RecordBatch]:
        if not part.left:
            return
        wanted = [[*dict.fromkeys([*self.same, *(c for s, c, _ in self.columns if s == side)])] for side in (0, 1)]
        sides = [rows_of(path, groups, *part.rows, columns) for path, groups, columns in zip((part.left, part.right), part.groups, wanted, strict=True)]
        held: list = [None, None]
        done, total = 0, part.rows[1] - part.rows[0]
        while done < total:
            for k in (0, 1):
                if held[k] is None:
                    held[k] = next(sides[k])
            n = min(h.num_rows for h in held)
            both = [h.slice(0, n) for h in held]
            for c in self.same:
                if not both[0].column(c).equals(both[1].column(c).cast(both[0].column(c).type)):
                    raise ValueError(f"{part.left} and {part.right} differ in {c} between rows {part.rows[0] + done} and {part.rows[0] + done + n}")
            yield pa.RecordBatch.from_arrays([both[s].column(c).cast(f.type) for (s, c, _), f in zip(self.columns, self.kind, strict=True)], schema=self.kind)
            held = [h.slice(n) if h.num_rows > n else None for h in held]
            done += n


def aligned(spark: SparkSession, left: list[str], right: list[str], columns: list[tuple[int, str, str]], *, same: list[str] | None = None, rows: int = PARTITION) -> DataFrame:
    """Two tables side by side, row by row: no key, no shuffle, no sort.

    ``left`` and ``right``: their files in order.  ``columns``: (side, column, name) of
    what is read; nothing else is.  Another number of files, or of rows of a file, is an error when it is
    planned, a difference in the columns ``same`` one when it is read.  A partition
    has whole row groups of the left side, about ``rows`` rows; row groups of the right may be cut otherwise.
    """
    spark.dataSource.register(AlignedTables)
    given = {"left": left, "right": right, "columns": columns, "same": same or []}
    return spark.read.format(AlignedTables.name()).options(rows=rows, **{k: json.dumps(v) for k, v in given.items()}).load()


def fetch(spark: SparkSession, files: list[str], positions: DataFrame, *, columns: list[str] | None = None, file: str = "file_name", row: str = "row_index") -> DataFrame:
    """The rows at given places, with ``file_name`` and ``row_index``, read from the row groups that have any.

    ``positions``: names of the files and row numbers in them; a name that isn't
    among ``files`` is an error, as is a row that a file doesn't have; repeated places give one row.  The
    driver reads the footers and sends where row groups begin; positions are dealt by row group, and
    a task reads one group's columns and takes the rows.
    """
    by_name = {f.rsplit("/", 1)[-1]: f for f in files}
    starts = {name: np.cumsum([0, *groups]).tolist() for name, groups in zip(by_name, footers(list(by_name.values())), strict=True)}
    kind = from_arrow_schema(parquet_file(files[0]).schema_arrow)
    wanted = columns or kind.names
    table = F.from_json(F.lit(json.dumps(starts)), "map<string,array<bigint>>")
    begun = F.element_at(table, F.col("file_name")) if len(starts) > 1 else F.when(F.col("file_name") == next(iter(starts)), F.element_at(table, F.col("file_name")))
    places = positions.select(F.col(file).alias("file_name"), F.col(row).cast("bigint").alias("row_index")).withColumn("_begun", begun)
    good = F.coalesce((F.col("row_index") >= 0) & (F.col("row_index") < F.element_at("_begun", -1)), F.lit(False))
    group = F.when(good, F.size(F.filter("_begun", lambda x: x <= F.col("row_index"))) - 1).otherwise(F.raise_error(F.concat(F.lit("no row "), F.coalesce(F.col("row_index").cast("string"), F.lit("null")), F.lit(" in file "), F.coalesce("file_name", F.lit("null")))).cast("int"))
    placed = places.select("file_name", "row_index", group.alias("row_group")).distinct()
    out_kind = f"file_name string, row_index bigint, {', '.join(f'`{c}` {kind[c].dataType.simpleString()}' for c in wanted)}"
    # Arrow types as Spark has them.
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType([kind[c] for c in wanted]))

    def read(key: tuple, mine: pa.Table) -> pa.Table:
        name, k = key[0].as_py(), key[1].as_py()
        at = np.sort(mine.column("row_index").to_numpy())
        got = parquet_file(by_name[name]).read_row_group(k, columns=wanted).select(wanted).take(pa.array(at - starts[name][k]))
        return pa.table([pa.array([name] * len(at), pa.string()), pa.array(at), *(c.cast(t.type) for c, t in zip(got.columns, types, strict=True))], names=["file_name", "row_index", *wanted])

    return placed.groupBy("file_name", "row_group").applyInArrow(read, out_kind)


def check_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, bytes, rows, problem) of each file: whether it ends as a Parquet file must, and how many rows its footer tells of.

    Files are dealt to tasks, which read the last bytes of each and its footer, no data.  ``problem`` is
    null for a sound file; a missing or unreadable one has its error there.
    """

    def check(path: str) -> tuple:
        try:
            store, at = _open(path)
            with store.open_input_file(at) as file:
                size = file.size()
                tail = file.read_at(min(8, size), max(0, size - 8))
                if size < 12 or tail[-4:] not in (b"PAR1", b"PARE"):
                    return size, None, "no trailer"
                if int.from_bytes(tail[:4], "little") + 12 > size:
                    return size, None, "short footer"
                return size, pq.ParquetFile(file).metadata.num_rows, None
        except Exception as e:
            return None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [check(f) for f in batch.column(0).to_pylist()]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["file", "bytes", "rows", "problem"])

    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks)
    return listed.mapInArrow(run, "file string, bytes bigint, rows bigint, problem string")
