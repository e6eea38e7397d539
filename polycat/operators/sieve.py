"""A sieve for weight systems with one polytope: cheap tests first, normal forms for what they leave.

S0 sorts weights and divides them by their common divisor; S1 merges equal ones, which
have one polytope.  S2 tells systems apart by their own numbers.  S3 decides
simplices whose vertices generate the lattice by their circuit, S4 those that are
alone with their circuit and quotient group, S5 other polytopes that are alone with
their signature.  S6 compares normal forms of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polycat.functions import weights as W
from polycat.kernel.batch import DIM, FULL, UNKNOWN, shapes
from polycat.kernel.canonical import digest, normal_form
from polycat.kernel.exact import determinants, smith_factors
from polycat.kernel.polytope import Polytope
from polycat.operators.cascade import _joined, _written
from polycat.operators.classify import nf_key, polytope_of

SHAPE = "stage string, sure boolean, signature string"


def _polytopes(rows: list[list[int]]) -> Iterator[tuple[int, Polytope | None, int]]:
    """(place, polytope or None, lattice points) of weight systems."""
    left = set(range(len(rows)))
    for s in shapes(np.array(rows, np.int64).reshape(-1, 6)):
        for k, at in enumerate(s.who.tolist()):
            if s.hulls.kind[k] != UNKNOWN:
                left.discard(at)
                facets = s.hulls.facets[k, : s.hulls.nf[k]]
                p = Polytope(s.hulls.vertices[k, : s.hulls.nv[k]], facets[:, :DIM], facets[:, DIM]) if s.hulls.kind[k] == FULL and s.inside[k] else None
                yield at, p, int(s.points[k])
    for at in sorted(left):
        yield at, *polytope_of([rows[at]])


def signature(p: Polytope, points: int) -> tuple[str, bool, str]:
    """(stage, whether an equal signature means an equal polytope, signature) of a polytope.

    A simplex around the origin: the sizes of the determinants of its vertices but
    one are its circuit times the index of the lattice that the vertices generate.
    """
    if len(p.vertices) == DIM + 1:
        circuit = sorted(abs(int(x)) for x in determinants(np.stack([np.delete(p.vertices, k, axis=0) for k in range(DIM + 1)])))
        index = int(np.gcd.reduce(circuit))
        if index == 1:
            return "S3", True, digest(["simplex", circuit])
        return "S4", False, digest(["simplex", circuit, list(smith_factors(p.vertices))])
    m = np.sort(p.pairing, axis=1).tolist()
    return "S5", False, digest([points, *p.pairing.shape, sorted(p.distances.tolist()), sorted(m), sorted(np.sort(p.pairing.T, axis=1).tolist())])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list = [(None, None, None)] * batch.num_rows
        for at, p, points in _polytopes(batch.column(0).to_pylist()):
            out[at] = (None, None, None) if p is None else signature(p, points)
        types = (pa.string(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))], names=[*batch.schema.names, "stage", "sure", "signature"])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list = [None] * batch.num_rows
        for at, p, _ in _polytopes(batch.column(0).to_pylist()):
            out[at] = None if p is None else nf_key([int(x) for x in normal_form(p).ravel()]).hex()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "form"])


def sieve(df: DataFrame, *, weights: str = "ws", trust_local: bool = False, tasks: int | None = None) -> DataFrame:
    """A row for each distinct weight system (up to order and factor) whose origin is strictly inside: how it was decided, and its class.

    Returns ``canonical`` (the weights as an array), ``members`` (rows with it), ``stage`` that
    decided it, ``class_id`` (the least weights, as text, of the systems with its
    polytope), ``class_systems`` and ``verdict``: SAME where other systems have its
    polytope, else DIFFERENT.  Null weights and ones that aren't positive are left out.

    S2 is only used with ``trust_local``: that its numbers are the same for all
    systems of one polytope is claimed, but we know no proof.  Without it the result
    doesn't depend on the claim.
    """
    spark = df.sparkSession
    ws = F.col(weights)
    good = (F.size(ws) == 6) & F.forall(ws, lambda x: x > 0)
    systems = df.where(good).groupBy(W.canonical(ws.cast("array<bigint>")).alias("canonical")).agg(F.count("*").cast("bigint").alias("members"))
    w = F.col("canonical")
    local = F.to_json(F.struct(W.distinct(w).alias("d"), W.multiplicities(w).alias("m"), W.ones(w).alias("o"), W.gorenstein(w).alias("g"))) if trust_local else F.lit("")
    systems = systems.where(W.may_be_interior(w)).select("canonical", "members", local.alias("local"))
    tasks = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if trust_local:
        sizes = _written(systems.groupBy("local").agg((F.count("*") == 1).alias("alone")))
        systems = _joined(systems, sizes, ["local"], "inner")
    else:
        systems = systems.withColumn("alone", F.lit(False))
    shaped = _written(systems.repartition(tasks).mapInArrow(_shapes, f"canonical array<bigint>, members bigint, local string, alone boolean, {SHAPE}").where("signature is not null"))
    groups = _written(shaped.groupBy("local", "signature").agg((F.count("*") == 1).alias("single")))
    placed = _joined(shaped, groups, ["local", "signature"], "inner")
    known = F.col("alone") | F.col("sure") | F.col("single")
    decided = placed.where(known).withColumn("stage", F.when(F.col("alone"), "S2").otherwise(F.col("stage"))).withColumn("key", F.concat_ws(":", "local", "signature"))
    rest = placed.where(~known).select("canonical", "members").repartition(tasks).mapInArrow(_forms, "canonical array<bigint>, members bigint, form string")
    rest = rest.select("canonical", "members", F.lit("S6").alias("stage"), F.col("form").alias("key"))
    every = _written(decided.select("canonical", "members", "stage", "key").unionByName(rest))
    classes = _written(every.groupBy("key").agg(F.min(W.shown(w)).alias("class_id"), F.count("*").cast("bigint").alias("class_systems")))
    out = _joined(every, classes, ["key"], "inner")
    return out.select("canonical", "members", "stage", "class_id", "class_systems", F.when(F.col("class_systems") > 1, "SAME").otherwise("DIFFERENT").alias("verdict"))


