"""Generators of weight systems, and of the shapes of combined ones."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, combinations_with_replacement, permutations, product
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polycat.functions.weights import common_divisor
from polycat.kernel.polytope import hull, lattice_points
from polycat.sources.files import hadoop
from polycat.storage import Workspace


def candidates(spark: SparkSession, low: int, high: int, *, width: int = 6) -> DataFrame:
    """All ascending coprime weight systems of the degrees from low to high whose largest weight is at most half the degree.

    Each weight is exploded between its predecessor and the even share of what is
    left, so no prefix that can't be finished is made.
    """
    out = spark.range(low, high + 1).select(F.col("id").alias("degree"), F.array().cast("array<bigint>").alias("weights"), F.col("id").alias("left"))
    for k in range(width - 1):
        least = F.lit(1).cast("bigint") if k == 0 else F.element_at("weights", -1)
        most = F.floor(F.col("left") / (width - k)).cast("bigint")
        grown = out.where(least <= most).withColumn("w", F.explode(F.sequence(least, most)))
        out = grown.select("degree", F.array_append("weights", F.col("w")).alias("weights"), (F.col("left") - F.col("w")).alias("left"))
    done = out.select("degree", F.array_append("weights", F.col("left")).alias("weights")).where(2 * F.element_at("weights", -1) <= F.col("degree"))
    return done.where(common_divisor(F.col("weights")) == 1)


def with_half_weight(weights: Column) -> Column:
    """A weight system with one more weight, half of the new degree."""
    return F.array_append(weights, F.aggregate(weights, F.lit(0).cast("bigint"), lambda a, x: a + x))


def combined_types(dim: int = 5, most: int = 5) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, shared coordinates) of combined weight systems of a dimension: the sum of (length - 1), less what is shared, is the dimension."""
    out = []
    for n in range(1, most + 1):
        for lengths in combinations_with_replacement(range(dim + 1, 1, -1), n):
            shared = sum(x - 1 for x in lengths) - dim
            if 0 <= shared <= (n - 1) * (min(lengths) - 1) and (n == 1) <= (shared == 0):
                out.append((lengths, shared))
    return out


def padded_row(weights: Column, before: Column, after: Column) -> Column:
    """A row of a combined system's matrix: its weights between zeros."""
    zero = F.lit(0).cast("bigint")
    return F.concat(F.array_repeat(zero, before), weights, F.array_repeat(zero, after))


def _extremes(points: list[tuple]) -> list[tuple[Fraction, ...]]:
    """The vertices of {q >= 0 : q . x = 1 for all points}, each with as few non-zero numbers as it can."""
    width = len(points[0])
    out: dict[tuple, None] = {}
    for n in range(1, width + 1):
        for support in combinations(range(width), n):
            q = _solved([[Fraction(x[k]) for k in support] for x in points])
            if q is not None and all(v > 0 for v in q):
                whole = [Fraction(0)] * width
                for k, v in zip(support, q, strict=True):
                    whole[k] = v
                out[tuple(whole)] = None
    return list(out)


def _solved(rows: list[list[Fraction]]) -> list[Fraction] | None:
    """The one solution of rows . q = 1, or None where there is none or more than one."""
    m = [[*r, Fraction(1)] for r in rows]
    width, top = len(rows[0]), 0
    for col in range(width):
        at = next((i for i in range(top, len(m)) if m[i][col]), None)
        if at is None:
            return None
        m[top], m[at] = m[at], m[top]
        m[top] = [x / m[top][col] for x in m[top]]
        for i in range(len(m)):
            if i != top and m[i][col]:
                m[i] = [x - m[i][col] * y for x, y in zip(m[i], m[top], strict=True)]
        top += 1
    return [r[-1] for r in m[:width]] if all(not r[-1] for r in m[width:]) else None


def _below(q: tuple[Fraction, ...]) -> Iterator[tuple[int, ...]]:
    """All integer x >= 0 with q . x < 1, for positive q."""

    def grow(head: tuple, left: Fraction) -> Iterator[tuple]:
        if len(head) == len(q):
            yield head
            return
        value = 0
        while value * q[len(head)] < left:
            yield from grow((*head, value), left - value * q[len(head)])
            value += 1

    yield from grow((), Fraction(1))


def _interior(weights: tuple[int, ...]) -> bool:
    if 2 * max(weights) > sum(weights):
        return False
    p = hull(lattice_points([list(weights)], [sum(weights)]))
    return p is not None and p.interior


def _name(points: list[tuple]) -> tuple[tuple, ...]:
    """A set of points by its least name under renaming of coordinates.

    Coordinates are ordered by the values that the points have there; only those with the same values are tried in all orders.
    """
    kinds: dict[tuple, list[int]] = {}
    for k in range(len(points[0])):
        kinds.setdefault(tuple(sorted(p[k] for p in points)), []).append(k)
    classes = [kinds[v] for v in sorted(kinds)]
    return min(tuple(sorted(tuple(p[k] for part in order for k in part) for p in points)) for order in product(*(permutations(c) for c in classes)))


def _grown(points: list[tuple]) -> tuple[tuple[int, ...] | None, set[tuple]]:
    """What follows from a set of points: a weight system, whose polytope has all of them, and the sets with one point more.

    The mean q of the extreme solutions is one candidate.  Any other q' has an x with q' . x = 1
    and q . x < 1, since else q . x >= 1 on its whole polytope, with equality inside; so
    all others come from one point more.
    """
    extremes = _extremes(points)
    if not extremes:
        return None, set()
    q = tuple(sum(c) / len(extremes) for c in zip(*extremes, strict=True))
    if min(q) <= 0:
        return None, set()
    scale = lcm(*(v.denominator for v in q))
    whole = [int(v * scale) for v in q]
    weights = tuple(sorted(w // gcd(*whole) for w in whole))
    more = set() if len(extremes) == 1 else {_name([*points, x]) for x in _below(q)}
    return (weights if _interior(weights) else None), more


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each weight system, and one for each set of points of the next level."""
    kinds = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))
    for batch in batches:
        for points in batch.column(0).to_pylist():
            weights, more = _grown([tuple(p) for p in points])
            rows = [(weights, None)] * (weights is not None) + [(None, m) for m in more]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] and list(r[k]) for r in rows], kind) for k, kind in enumerate(kinds)], names=["weights", "points"])


def search(spark: SparkSession, width: int, folder: str | None = None, *, levels: int | None = None) -> DataFrame:
    """All weight systems of ``width`` weights whose origin is strictly inside, by adding points, whatever their degree.

    A level has all sets of so many points, each once: a set's name doesn't depend on how
    coordinates are called, and names that several tasks found are merged before the next
    level is dealt out.  There are as many levels as weights, at most; ``levels`` ends it
    before.  With ``folder`` levels are kept there, and a search that was stopped goes on
    after the last one that was finished.  There are 3 systems of three weights and
    95 of four; of five, 184,026, and of six so many that only a cluster should be asked.
    """
    folder = folder or Workspace(spark, "search").base
    frontier = spark.createDataFrame([([[1] * width],)], "points array<array<bigint>>")
    found, k = None, 0
    while True:
        path = f"{folder.rstrip('/')}/level={k}"
        store, done = hadoop(spark, f"{path}/_SUCCESS")
        if not store.exists(done):
            frontier.repartition("points").mapInArrow(_level, "weights array<bigint>, points array<array<bigint>>").distinct().write.mode("overwrite").option("compression", "zstd").parquet(path)
        level = spark.read.schema("weights array<bigint>, points array<array<bigint>>").parquet(path)
        found = level if found is None else found.unionByName(level)
        frontier, k = level.where("points is not null").select("points"), k + 1
        if k == levels or not frontier.limit(1).count():
            break
    out = found.where("weights is not null").select("weights").distinct()
    return out.select(F.aggregate("weights", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("degree"), "weights")
