"""Exact integer algebra on columns of matrices (``array<array<bigint>>``): no floating point anywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from polycat.kernel.exact import determinant, integer_kernel, smith_factors


def _with(df: DataFrame, matrix: str, name: str, kind: str, arrow: pa.DataType, value: Callable) -> DataFrame:
    source = df.drop(name)  # of any case, as Spark compares names
    names = source.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [None if m is None else value(m) for m in batch.column(names.index(matrix)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, arrow)], names=[*names, name])

    return source.mapInArrow(run, f"{fields}, {name} {kind}")


def with_determinant(df: DataFrame, matrix: str, *, name: str = "determinant") -> DataFrame:
    """``df`` with the determinants of square matrices; one beyond 64 bits is an error."""
    return _with(df, matrix, name, "bigint", pa.int64(), determinant)


def with_smith_factors(df: DataFrame, matrix: str, *, name: str = "smith_factors") -> DataFrame:
    """``df`` with the invariant factors that aren't zero."""
    return _with(df, matrix, name, "array<bigint>", pa.list_(pa.int64()), lambda m: list(smith_factors(m)))


def with_integer_kernel(df: DataFrame, matrix: str, *, name: str = "integer_kernel") -> DataFrame:
    """``df`` with primitive integer vectors that span the right kernel."""
    return _with(df, matrix, name, "array<array<bigint>>", pa.list_(pa.list_(pa.int64())), lambda m: [[int(x) for x in r] for r in integer_kernel(m)])
