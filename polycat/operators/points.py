"""Lattice points of large degree: counts of solutions by partial sums, an array of all degrees at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solutions(weights: list[int]) -> int:
    """The number of ways to write the sum of some positive weights as a sum of them, repeated; exact.

    The ways to write every degree up to the sum without some weight become those with it by adding up, along each residue modulo
    the weight: so each weight costs one pass over the degrees.
    """
    degree = sum(weights)
    small = degree + len(weights) < 5000 and len(weights) <= 6  # binomial(degree + 5, 5) fits then
    ways = np.zeros(degree + 1, np.int64 if small else object)
    ways[0] = 1
    for w in sorted(weights, reverse=True):
        rows = -(-(degree + 1) // w)
        table = np.zeros(rows * w, ways.dtype)
        table[: degree + 1] = ways
        ways = np.cumsum(table.reshape(rows, w), axis=0).ravel()[: degree + 1]
    return int(ways[degree])


def with_point_count(df: DataFrame, weights: str, name: str = "points") -> DataFrame:
    """``df`` with the number of lattice points of the polytope of each weight system (a bigint array).

    Each distinct system is counted once: the distinct ones are grouped first and joined back, so a system of any
    frequency costs one count.  Null, empty and not positive weights give null; a number beyond 64 bits is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [solutions(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["_system", "_points"])

    sorted_ = F.array_sort(F.col(f"`{weights}`"))
    good = F.coalesce((F.size(sorted_) > 0) & F.forall(sorted_, lambda x: F.coalesce(x > 0, F.lit(False))), F.lit(False))
    # The table's own columns travel as one, so that no name of theirs meets one of these.
    rows = df.drop(name).select(F.struct(*(F.col(f"`{c}`") for c in df.drop(name).columns)).alias("_kept"), F.when(good, sorted_).alias("_system"))
    counted = rows.select("_system").where("_system is not null").distinct().mapInArrow(run, "_system array<bigint>, _points bigint")
    out = rows.join(counted, "_system", "left")
    return out.select(*(F.col(f"_kept.`{c}`").alias(c) for c in df.drop(name).columns), F.col("_points").alias(name))
