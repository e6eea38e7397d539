"""The geometry kernel on DataFrames: one Arrow pass, memory of one batch, a registry of kernels."""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polycat.kernel.batch import DIM, FULL, WIDTH, classified, hulls
from polycat.kernel.canonical import LAYERS, MOST_LEAVES, isomorphism, layers, normal_form, normal_form_bytes
from polycat.kernel.hodge import hodge_numbers_of
from polycat.kernel.polytope import Polytope, hull, lattice_points
from polycat.operators import cascade


def polytope_of(rows: list[list[int]], degrees: list[int] | None = None) -> tuple[Polytope | None, int]:
    """The polytope of a weight system and its number of lattice points; None where the origin isn't strictly inside."""
    if not rows or any(x < 0 for r in rows for x in r):
        return None, 0
    sums = [sum(r) for r in rows]
    degrees = [d or s for d, s in zip(degrees or sums, sums, strict=True)]
    if any(s <= 0 for s in sums) or degrees != sums or (len(rows) == 1 and min(rows[0]) <= 0):
        return None, 0
    points = lattice_points(rows, degrees)
    p = hull(points)
    return (p if p is not None and p.interior else None), len(points)


def exact_kernel(rows: list[list[int]], degrees: list[int] | None = None) -> tuple | None:
    """(vertices, facets, points, normal form as a flat list) or None."""
    p, points = polytope_of(rows, degrees)
    if p is None:
        return None
    return len(p.vertices), len(p.normals), points, [int(x) for x in normal_form(p).ravel()]


System = tuple[tuple, tuple]


def exact_batch(systems: list[System]) -> list[tuple | None]:
    """The exact kernel on (rows, degrees) pairs, one after the other."""
    return [exact_kernel([list(r) for r in rows], list(degrees)) if rows else None for rows, degrees in systems]


def array_batch(systems: list[System]) -> list[tuple | None]:
    """Single weight systems as one array; combined ones, and those whose numbers are too large for it, exactly."""
    out: list = [False] * len(systems)
    plain = [k for k, (rows, degrees) in enumerate(systems) if len(rows) == 1 and len(rows[0]) == WIDTH and min(rows[0]) > 0 and (not degrees or degrees[0] in (0, sum(rows[0])))]
    if plain:
        for k, got in zip(plain, classified(np.array([systems[k][0][0] for k in plain], np.int64), MOST_LEAVES), strict=True):
            out[k] = got
    rest = [k for k, got in enumerate(out) if got is False]
    for k, got in zip(rest, exact_batch([systems[k] for k in rest]), strict=True):
        out[k] = got
    return out


#: A kernel takes a batch of systems and returns what ``exact_kernel`` says of each.
KERNELS: dict[str, Callable[[list[System]], list[tuple | None]]] = {"array": array_batch, "exact": exact_batch}


def kernel(name: str = "auto") -> Callable[[list[System]], list[tuple | None]]:
    """A kernel by name; ``auto`` is the first that there is."""
    if name == "auto":
        return next(iter(KERNELS.values()))
    if name not in KERNELS:
        raise ValueError(f"there is no kernel {name!r}, only {', '.join(KERNELS)}")
    return KERNELS[name]


def nf_key(flat: list[int]) -> bytes:
    """XXH3-128 (seed 0) of the normal form's bytes, high half first, so that bytes order as the number does."""
    import xxhash

    return xxhash.xxh3_128_digest(struct.pack(f"<{len(flat)}q", *flat))


KERNEL_COLUMNS = "ok boolean, vertex_count int, facet_count int, point_count int, nf array<bigint>, nf_key binary"
REMEMBERED = 1 << 14


def classify(df: DataFrame, *, backend: str = "auto", tasks: int | None = None, hashed: bool = True, remember: bool = True) -> DataFrame:
    """``df`` (with ``rows`` and ``degrees``) and what the kernel says of each row; its own counts replace those of the input.

    Rows are dealt anew over ``tasks`` (default: the session's shuffle partitions, or
    its parallelism if that is more), since a row's cost grows with its lattice points.  A task computes the
    systems of an Arrow batch together and remembers its last ones, so repeats are computed once.
    ``hashed=False`` leaves the key null, to time the kernel alone;
    with ``remember=False`` the kernel runs on every row.
    """
    compute = kernel(backend)
    replaced = {"ok", "vertex_count", "facet_count", "point_count", "nf", "nf_key"}
    source = df.drop(*replaced)  # of any case, as Spark compares names
    names = source.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[tuple, tuple] = OrderedDict()
        for batch in batches:
            rows = batch.column(names.index("rows")).to_pylist()
            degrees = batch.column(names.index("degrees")).to_pylist()
            keys = [(tuple(map(tuple, r or ())), tuple(d or ())) for r, d in zip(rows, degrees, strict=True)]
            fresh = [k for k in dict.fromkeys(keys) if k not in known] if remember else keys
            made = [(False, None, None, None, None, None) if got is None else (True, *got, nf_key(got[3]) if hashed else None) for got in compute(fresh)]
            if remember:
                known.update(zip(fresh, made, strict=True))
                made = [known[k] for k in keys]
                while len(known) > REMEMBERED:
                    known.popitem(last=False)
            out = made
            types = [pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            new = [pa.array([x[k] for x in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "ok", "vertex_count", "facet_count", "point_count", "nf", "nf_key"])

    spark = source.sparkSession
    tasks = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return source.repartition(tasks).mapInArrow(run, f"{fields}, {KERNEL_COLUMNS}")


def vertices_of(flat: list[int]) -> Polytope | None:
    """The polytope whose normal form is given, row by row."""
    return polytopes_of([flat])[0]


def polytopes_of(forms: list[list[int] | None]) -> list[Polytope | None]:
    """The polytopes whose normal forms are given, all of a batch at once; None for a null one."""
    some = [k for k, flat in enumerate(forms) if flat]
    out: list[Polytope | None] = [None] * len(forms)
    if not some:
        return out
    points = [np.array(forms[k], np.int64).reshape(DIM, -1).T for k in some]
    h = hulls(np.concatenate(points), np.repeat(np.arange(len(some)), [len(x) for x in points]), len(some))
    for j, k in enumerate(some):
        facets = h.facets[j, : h.nf[j]]
        out[k] = Polytope(h.vertices[j, : h.nv[j]], facets[:, :DIM], facets[:, DIM]) if h.kind[j] == FULL else hull(points[j])
    return out


def fingerprints(df: DataFrame, *, nf: str = "nf", wanted: tuple = LAYERS) -> DataFrame:
    """``df`` with a column for each wanted layer of invariants and ``full_key`` over all of them; null where ``nf`` is."""
    from polycat.kernel.canonical import digest

    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for p in polytopes_of(batch.column(names.index(nf)).to_pylist()):
                each = layers(p, wanted) if p is not None else dict.fromkeys(wanted)
                got.append([*(each[k] for k in wanted), digest([each[k] for k in wanted]) if p is not None else None])
            new = [pa.array([g[k] for g in got], pa.string()) for k in range(len(wanted) + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *wanted, "full_key"])

    return df.mapInArrow(run, ", ".join([fields, *(f"{k} string" for k in wanted), "full_key string"]))


#: Polytopes whose lattice points are looked at together.
AT_ONCE = 256

HODGE = ("dual_point_count", "h11", "h12", "h13", "h22", "chi")


def with_hodge(df: DataFrame, *, nf: str = "nf") -> DataFrame:
    """``df`` with ``reflexive`` and, for reflexive polytopes, the dual's point count, the Hodge numbers and the Euler number.

    Columns of these names are replaced; all but ``reflexive`` are null for other
    polytopes, and all where ``nf`` is null.
    """
    source = df.drop("reflexive", *HODGE)
    names = source.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = polytopes_of(batch.column(names.index(nf)).to_pylist())
            flags = [None if p is None else p.reflexive for p in found]
            rows: list[dict] = [{} for _ in found]
            some = [k for k, flag in enumerate(flags) if flag]
            for at in range(0, len(some), AT_ONCE):  # their lattice points are in memory together
                for k, r in zip(some[at : at + AT_ONCE], hodge_numbers_of([found[k] for k in some[at : at + AT_ONCE]]), strict=True):
                    rows[k] = r
            new = [pa.array(flags, pa.bool_()), *(pa.array([r.get(k) for r in rows], pa.int64()) for k in HODGE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "reflexive", *HODGE])

    return source.mapInArrow(run, ", ".join([fields, "reflexive boolean", *(f"{k} bigint" for k in HODGE)]))


def with_volume(df: DataFrame, *, nf: str = "nf") -> DataFrame:
    """``df`` with ``volume``, in units of the smallest lattice simplex; null where ``nf`` is."""
    source = df.drop("volume")
    names = source.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [None if p is None else p.volume for p in polytopes_of(batch.column(names.index(nf)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64())], names=[*names, "volume"])

    return source.mapInArrow(run, f"{fields}, volume bigint")


def dump(line: str) -> str:
    """A weight line ``degree w0 w1 ...`` as ``dim vertices entries...`` of its normal form, or ``FAIL``."""
    numbers = [int(x) for x in line.split()]
    (got,) = kernel()([((tuple(numbers[1:]),), (numbers[0],))]) if len(numbers) == 7 else (None,)
    return "FAIL" if got is None else " ".join(map(str, (5, got[0], *got[3])))


def isomorphic_pairs(pairs: DataFrame, *, left: str = "nf_a", right: str = "nf_b", cap: int = 200_000) -> DataFrame:
    """``pairs`` with ``verdict``: EQUIVALENT, INEQUIVALENT, DEGENERATE or TOO_BIG."""
    names = pairs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(polytopes_of(batch.column(names.index(c)).to_pylist()) for c in (left, right)), strict=True)
            verdicts = []
            for p, q in both:
                verdicts.append(None if p is None or q is None else isomorphism(p, q, cap))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdicts, pa.string())], names=[*names, "verdict"])

    return pairs.mapInArrow(run, f"{fields}, verdict string")


def isomorphism_classes(forms: DataFrame, group: list[str], *, index: str = "nf_key", nf: str = "nf", cap: int = 200_000) -> DataFrame:
    """The classes of isomorphic polytopes within each group, by representatives (``cascade.classes_within``); what couldn't be decided is counted in ``undecided``."""

    def tested(pairs: DataFrame) -> DataFrame:
        verdict = F.col("verdict")
        return isomorphic_pairs(pairs, left=f"{nf}_a", right=f"{nf}_b", cap=cap).withColumn("same", F.when(verdict == "EQUIVALENT", True).when(verdict == "INEQUIVALENT", False))

    return cascade.classes_within(forms, group, index, [nf], tested)


def sha256_of_normal_form(nf):
    """SHA-256 of the canonical bytes of a normal-form column, natively."""
    hexed = F.transform(nf, lambda x: F.lpad(F.hex(x), 16, "0"))
    little = F.transform(hexed, lambda h: F.array_join(F.reverse(F.transform(F.sequence(F.lit(1), F.lit(15), F.lit(2)), lambda k: F.substring(h, k, F.lit(2)))), ""))
    return F.sha2(F.unhex(F.array_join(little, "")), 256)


DIGESTS: dict[str, Callable[[bytes], bytes]] = {}


def digest_registry() -> dict[str, Callable[[bytes], bytes]]:
    """Digests of normal-form bytes by name; xxh3_128 only where its module is there."""
    import hashlib

    found = {"sha256": lambda b: hashlib.sha256(b).digest(), "blake2b128": lambda b: hashlib.blake2b(b, digest_size=16).digest(), **DIGESTS}
    try:
        import xxhash

        found["xxh3_128"] = xxhash.xxh3_128_digest
    except ImportError:
        pass
    return found


# The names of the digests and of the fields of a golden record.
def golden_record(weights: list[int]) -> dict:
    """The record that a regression file keeps of a weight system."""
    p, _ = polytope_of([weights])
    form = normal_form(p)
    data = normal_form_bytes(form)
    return {"ws": " ".join(map(str, [sum(weights), *weights])), "dim": form.shape[0], "nv": form.shape[1], "nf": [[int(x) for x in r] for r in form], "bytes_len": len(data), "digests": {k: f(data).hex() for k, f in sorted(digest_registry().items())}}
