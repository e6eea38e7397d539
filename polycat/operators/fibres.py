"""Which polytopes of a catalogue cheap invariants tell apart: the cascade with its real keys, and diagnostics of what is left.

Free invariants are integer columns of the table.  The geometry key is a digest of
the layers L1 and Lpm, computed from the packed normal form of those rows that
collide on the free ones.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polycat.kernel.canonical import chirotope_counts, digest, layers
from polycat.operators import cascade as C
from polycat.operators.classify import AT_ONCE, REMEMBERED, polytopes_of

# The columns that cost nothing.
FREE = ["h11", "h12", "h13", "h22", "chi", "point_count", "dual_point_count", "bh_mp", "bh_np", "bh_mv", "bh_nv"]


def unpacked_forms(blobs: pa.Array) -> list[list[int] | None]:
    """Packed normal forms (32-bit, row by row) as flat lists."""
    return [None if b is None else np.frombuffer(b, "<i4").tolist() for b in blobs.to_pylist()]


def _with(df: DataFrame, blob: str, columns: dict[str, tuple[str, pa.DataType]], value) -> DataFrame:
    source = df.drop(*columns)  # of any case, as Spark compares names
    names = source.columns
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields), *(f"{c} {t}" for c, (t, _) in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[bytes | None, tuple] = OrderedDict({None: (None,) * len(columns)})
        for batch in batches:
            blobs = batch.column(names.index(blob))
            for at in range(0, batch.num_rows, AT_ONCE):  # their hulls are in memory together
                some = blobs[at : at + AT_ONCE]
                mine = some.to_pylist()
                fresh = [b for b in dict.fromkeys(mine) if b not in known]
                for b, p in zip(fresh, polytopes_of(unpacked_forms(pa.array(fresh, pa.binary()))), strict=True):
                    known[b] = (None,) * len(columns) if p is None else value(p)
                rows = [known[b] for b in mine]
                while len(known) > REMEMBERED:
                    known.popitem(last=False)
                known.setdefault(None, (None,) * len(columns))
                new = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns.values())]
                yield pa.RecordBatch.from_arrays([*(c[at : at + AT_ONCE] for c in batch.columns), *new], names=[*names, *columns])

    return source.mapInArrow(run, fields)


def geometry_key(df: DataFrame, *, blob: str = "nf_vertices") -> DataFrame:
    """``df`` with ``geometry_key`` (a digest of L1 and Lpm) and ``reflexive``; both null where the blob is."""

    def value(p):
        each = layers(p, ("L1", "Lpm"))
        return digest([each["L1"], each["Lpm"]]), p.reflexive

    return _with(df, blob, {"geometry_key": ("string", pa.string()), "reflexive": ("boolean", pa.bool_())}, value)


def chirotopes(df: DataFrame, *, blob: str = "nf_vertices") -> DataFrame:
    """``df`` with the numbers of positive, negative and zero brackets of the vertices in lexicographic order."""
    names = ("n_positive", "n_negative", "n_zero")
    return _with(df, blob, {c: ("bigint", pa.int64()) for c in names}, lambda p: chirotope_counts(p.vertices))


def canonical_points(nf: Column, dim: int = 5) -> Column:
    """The vertices of a flat normal form as a sorted array of points: equal for one point set in any order."""
    width = F.floor(F.size(nf) / dim).cast("int")
    point = lambda j: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.get(nf, i * width + j))
    return F.when(width > 0, F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), point)))


def cheap_keys(df: DataFrame, free: list[str] | None = None, *, blob: str = "nf_vertices") -> DataFrame:
    """``df`` with ``cheap_key``: free invariants and geometry key as one."""
    free = [c for c in FREE if c in df.columns] if free is None else free
    return geometry_key(df, blob=blob).withColumn("cheap_key", F.sha2(F.to_json(F.struct(*free, "geometry_key"), {"ignoreNullFields": "false"}), 256))


def completeness(df: DataFrame, free: list[str] | None = None, *, blob: str = "nf_vertices") -> DataFrame:
    """One row: how many polytopes the free invariants tell apart, how many the geometry key then does, and how many of those tested aren't reflexive."""
    free = [c for c in FREE if c in df.columns] if free is None else free
    out = C.cascade_report(df, free, lambda d: geometry_key(d, blob=blob), "geometry_key", flag="reflexive")
    return out.withColumnRenamed("unflagged", "nonreflexive_tested")


def residual(df: DataFrame, free: list[str] | None = None, *, blob: str = "nf_vertices") -> DataFrame:
    """The rows that free invariants and geometry key leave together, with ``members`` of their group."""
    free = [c for c in FREE if c in df.columns] if free is None else free
    return C.cascade(df, free, lambda d: geometry_key(d, blob=blob), "geometry_key")


def resolution(left: DataFrame, group: list[str], *, nf: str = "nf") -> DataFrame:
    """For each group of a residual: members, and distinct keys after the layers Lar, Lbr and Los, with a verdict.

    ``left`` has ``group`` and the layers as columns (see ``classify.fingerprints``).
    """
    count = lambda *layer: F.count_distinct(*layer).cast("bigint")
    out = left.groupBy(*group).agg(F.count("*").cast("bigint").alias("members"), count("Lar").alias("after_lar"), count("Lar", "Lbr").alias("after_lbr"), count("Lar", "Lbr", "Los").alias("after_los"))
    verdict = F.when(F.col("after_lar") == F.col("members"), "RESOLVED BY Lar").when(F.col("after_lbr") == F.col("members"), "RESOLVED BY Lbr")
    return out.withColumn("verdict", verdict.when(F.col("after_los") == F.col("members"), "RESOLVED BY Los").otherwise("STILL COLLIDING"))


def diagnostics(left: DataFrame, group: list[str], *, blob: str = "nf_vertices", nf: str = "nf") -> DataFrame:
    """For each group: whether blobs are the same, whether point sets are, and whether bracket signs differ where point sets do."""
    signs = F.concat_ws(" ", "n_positive", "n_negative", "n_zero")
    rows = chirotopes(left, blob=blob).withColumn("_points", F.to_json(canonical_points(F.col(nf)))).withColumn("_signs", signs)
    out = C.identical_members(rows, group, blob, "_points")
    differ = rows.groupBy(*group).agg((F.min("_signs") != F.max("_signs")).alias("signs_differ"))
    return C._joined(out, differ, group, "inner")
