"""Near-duplicate documents: MinHash bands, verification, components by alternating stars.

A document is the set of its distinct word shingles.  Documents with one set are
one class and go on as one.  Universal hashes give each class its minima; classes
that share all minima of a band are candidates.  In a bucket only links to a
centre are tried at first, so that a bucket of n documents that hang together
costs n links, not n^2.  Members of buckets that are then still apart are looked
at by their rarest shingles: two sets that overlap enough share one among the
first few of each in any fixed order, so a set that shares none with another part
is left out; the others are compared in blocks.
A candidate's link holds if the full sets overlap enough.  Components come from
alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polycat.llm.arrays import LOWER, SPACE, Words, is_long, mix, sliced, steps, text_bytes, word_hashes
from polycat.llm.filters import passes, row_filter
from polycat.llm.shared import Workspace, id_key, tidy


def _long_shingles(data: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one long text, piece by piece."""
    factors = mix(np.arange(width, dtype=np.uint64), 3) | np.uint64(1)
    found, before, words = np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
    for h in word_hashes(data, SPACE):
        run = np.concatenate([before, h])
        words += len(h)
        n = len(run) - width + 1
        if n > 0:
            value = np.full(n, width, np.uint64)
            for k in range(width):
                value += run[k : k + n] * factors[k]
            found = np.union1d(found, mix(value))
        before = run[-(width - 1) :] if width > 1 else run[:0]
    if 0 < words < width:
        found = mix(np.array([words + sum(int(x) * int(f) for x, f in zip(before, factors, strict=False)) & 0xFFFFFFFFFFFFFFFF], np.uint64))
    return found


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, and their offsets by text."""
    if is_long(offsets):
        found = _long_shingles(data, width)
        return found, np.array([0, len(found)])
    data = LOWER[data]
    words = Words(data, offsets)
    h = words.hashes(data)
    n_words = np.diff(words.first)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(words.rows), n)
    begin = np.repeat(words.first[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    have = np.minimum(width, n_words)[owner]
    padded = np.append(h, np.zeros(width, np.uint64))
    factors = mix(np.arange(width, dtype=np.uint64), 3) | np.uint64(1)
    value = have.astype(np.uint64)
    for k in range(width):
        value += np.where(k < have, padded[begin + k], np.uint64(0)) * factors[k]
    value = mix(value)
    first = np.concatenate([[0], np.cumsum(n)])
    sets = [np.unique(value[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


#: Numbers of one large set that are worked on at once.
MOST_VALUES = 1 << 20


@lru_cache
def hash_family(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of n universal hashes of 64-bit integers."""
    draw = mix(np.arange(2 * n, dtype=np.uint64), seed)
    return draw[:n] | np.uint64(1), draw[n:]


def minima(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The n hash minima (high 32 bits) of each set that isn't empty; rows of other sets are 0."""
    sets = len(first) - 1
    out = np.zeros((sets, n), np.uint32)
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out
    a, b = hash_family(n)
    begin = first[:-1][some]
    for k in range(n):
        if len(values) > MOST_VALUES and len(some) == 1:  # one large set, some of it at a time
            least = min(int((values[x : x + MOST_VALUES] * a[k] + b[k]).min()) for x in range(0, len(values), MOST_VALUES))
            out[some, k] = least >> 32
        else:
            out[some, k] = np.minimum.reduceat(values * a[k] + b[k], begin) >> np.uint64(32)
    return out


def band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` minima; the band's number is part of it."""
    out = np.zeros((len(low), low.shape[1] // rows), np.uint64)
    for band in range(out.shape[1]):
        key = np.full(len(low), band, np.uint64)
        for k in range(rows):
            key = mix(key ^ (low[:, band * rows + k].astype(np.uint64) << np.uint64(16)), k)
        out[:, band] = key
    return out


def _digest(values: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128 bits that depend on the set alone; null for the empty set."""
    out: list[bytes | None] = [None] * (len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(values) > MOST_VALUES and len(some) == 1:
        both = [sum(int(mix(values[x : x + MOST_VALUES], s).sum(dtype=np.uint64)) for x in range(0, len(values), MOST_VALUES)) & 0xFFFFFFFFFFFFFFFF for s in (1, 2)]
        out[int(some[0])] = np.array(both, ">u8").tobytes()
    elif len(some):
        both = np.stack([np.add.reduceat(mix(values, s), first[:-1][some]) for s in (1, 2)], 1).astype(">u8")
        for k, row in zip(some.tolist(), both, strict=True):
            out[k] = row.tobytes()
    return out


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))


def _signed(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in steps(offsets):
                values, first = shingles(*sliced(data, offsets, a, b), width)
                keys = band_keys(minima(values, first, bands * rows), rows)
                n = np.diff(first)
                each = np.where(n > 0, bands, 0)
                arrays = [*(batch.column(k)[a:b] for k in (0, 1, 3)), pa.array(n), pa.array(_digest(values, first), pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, _lists(keys[n > 0].ravel(), np.concatenate([[0], np.cumsum(each)]))], names=["row", "id", "text_key", "n", "node", "bands"])

    return run


def _sets(width: int, sent):
    """The sets of those rows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy()
            some = batch.filter(pa.array(passes(sent.value, h)))
            data, offsets = text_bytes(some.column(1))
            for a, b in steps(offsets):
                values, first = shingles(*sliced(data, offsets, a, b), width)
                yield pa.RecordBatch.from_arrays([pa.array(_digest(values, first), pa.binary()), _lists(values, first)], names=["node", "set"])

    return run


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label) of all nodes that have links, by alternating large-star and small-star.

    ``links`` has columns a and b.  Each step is written to the shared folder.  A
    node's neighbours are never gathered: a step is two aggregates, each joined to what
    it was counted from.  Where there are many links the aggregates are written first,
    since Spark then can split a node that has most of them.
    """
    edges = work.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    state, step = (edges.count(), None), 0
    while True:
        step += 1
        written = (lambda df, what: work.save(df, f"{name}-{step}-{what}")) if state[0] > MANY_LINKS else lambda df, what: df  # noqa: B023
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = work.save(small, f"{name}-{step}")
        for old in [n for n in work.names if n.startswith(f"{name}-") and n != f"{name}-{step}"]:
            work.drop(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    labels = work.save(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), f"{name}-labels")
    tidy(work.spark)  # of the broadcasts of all rounds
    return labels


BLOCK, BLOCK_VALUES = 256, 1 << 18
#: Links from which on a step's aggregates are written; what comes out is the same.
MANY_LINKS = 1 << 20
#: Buckets of the counts that order shingles by how rare they are (8 MB on the driver, whatever the input).
COUNT_BITS = 20


def _block_links(percent: int):
    """Links between the parts in two blocks of sets, enough of them to join all parts that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                sides = [batch.column(c)[k].values for c in (0, 1)]
                found += _joined(*(({f: side.field(f) for f in ("node", "label", "set")}) for side in sides), percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.binary()) for c in (0, 1)], names=["a", "b"])

    return run


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        total += np.bincount(_bucket(batch.column(0).flatten().to_numpy()), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def _rarest(percent: int, sent):
    """The first shingles of each set, rarest first: so many that a set which overlaps enough has one of them among its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(2)
            values, n = sets.flatten().to_numpy(), np.diff(sets.offsets.to_numpy())
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((values, sent.value[_bucket(values)], owner))
            # A set that is linked shares percent / 100 of this one's shingles at least, and so misses the others at most.
            take = n - -(-percent * n // 100) + 1
            place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            first = place < np.repeat(take, n)
            at = pa.array(owner[order][first])
            yield pa.RecordBatch.from_arrays([pa.array(values[order][first]), batch.column(0).take(at), batch.column(1).take(at)], names=["bucket", "node", "label"])

    return run


def _still_apart(buckets: DataFrame, star: DataFrame, sets: DataFrame, work: Workspace, percent: int) -> DataFrame:
    """(bucket, node, label) of the buckets that have several parts, without nodes that share no rare shingle with any other part.

    Tables that are joined back to what they were counted from are written first:
    Spark can then split hot keys.
    """
    placed = work.save(buckets.join(star, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "placed-buckets")
    apart = work.save(placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"), "buckets-apart")
    nodes = placed.join(apart, "bucket", "left_semi").groupBy("node").agg(F.first("label").alias("label"))
    mine = work.save(nodes.join(sets, "node").select("node", "label", "set"), "sets-apart")
    got = mine.select("set").mapInArrow(_counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    sent = mine.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))
    rare = mine.mapInArrow(_rarest(percent, sent), "bucket bigint, node binary, label binary")
    shared = work.save(rare.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"), "rare-shared")
    left = work.save(rare.join(shared, "bucket", "left_semi").select("node").distinct(), "meeting")
    placed = work.save(placed.join(apart, "bucket", "left_semi").join(left, "node", "left_semi"), "apart")
    again = work.save(placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"), "still-apart")
    for name in ("placed-buckets", "sets-apart"):
        work.drop(name)
    return placed.join(again, "bucket", "left_semi")


def overlaps(one: pa.Array, two: pa.Array) -> np.ndarray:
    """Sizes of the intersections of each set of one list with each of another."""
    values = [x.flatten().to_numpy() for x in (one, two)]
    owner = [np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())) for x in (one, two)]
    shared = np.intersect1d(values[0], values[1])
    for side in (0, 1):
        at = np.searchsorted(shared, values[side])
        at[at == len(shared)] = 0
        here = shared[at] == values[side] if len(shared) else np.zeros(len(at), bool)
        values[side], owner[side] = at[here], owner[side][here]
    out = np.zeros((len(one), len(two)), np.float64)
    order = [np.argsort(v, kind="stable") for v in values]
    for lo in range(0, len(shared), 4096):
        dense = []
        for side, n in ((0, len(one)), (1, len(two))):
            v = values[side][order[side]]
            a, b = np.searchsorted(v, (lo, lo + 4096))
            m = np.zeros((n, min(4096, len(shared) - lo)), np.float32)
            m[owner[side][order[side][a:b]], v[a:b] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _joined(one: dict, two: dict, percent: int) -> list[tuple[bytes, bytes]]:
    both = overlaps(one["set"], two["set"])
    sizes = [np.diff(x["set"].offsets.to_numpy()) for x in (one, two)]
    union = sizes[0][:, None] + sizes[1][None, :] - both
    labels = [x["label"].to_pylist() for x in (one, two)]
    nodes = [x["node"].to_pylist() for x in (one, two)]
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := parent.get(x, x)) != x:
            x = y
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(100 * both >= percent * union)), strict=True):
        a, b = root(labels[0][i]), root(labels[1][j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((nodes[0][i], nodes[1][j]))
    return out


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = 32, rows: int = 6, with_text_key: bool = False) -> DataFrame:
    """The group of near duplicates that each row of ``docs`` belongs to.

    A document's set: the distinct sequences of ``width`` words (split at ASCII
    white space, A-Z lower-cased); with fewer words, all of them as one.  Two
    documents are linked if 100 * intersection >= ``percent`` * union; a group is
    what links connect.  A pair at 0.85 shares no band once in some 4 million
    with the given ``bands`` and ``rows``; every link that is used is confirmed on
    full sets of 64-bit shingle hashes.

    Returns the id, ``n_shingles``, ``component_id`` (the smallest id of the group)
    and ``kept``: one row of each group, that of the smallest id; where rows
    repeat with one id, one of them; on request also ``text_key``, the text's xxhash64.  A null or blank text has no shingles, is
    linked with nothing and kept.  A null id comes after all others; a group
    without any other has a null ``component_id``.  No rows give none.  Other columns of ``docs`` are
    not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near")
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    numbered = source.select(F.monotonically_increasing_id().alias("row"), "id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    signed = work.save(numbered.mapInArrow(_signed(width, bands, rows), f"row bigint, id {kind}, text_key bigint, n bigint, node binary, bands array<bigint>"), "signed")
    # Classes of equal sets, and the buckets of two or more of them.
    classes = signed.where("node is not null").select("node", "bands", "id", "n").dropDuplicates(["node"])
    classes = work.save(classes, "classes")
    spread = classes.select("node", F.explode("bands").alias("bucket"))
    shared = work.save(spread.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("centre")).where("members > 1"), "shared")
    buckets = work.save(spread.join(shared.select("bucket", "centre"), "bucket"), "buckets")
    wanted = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "id", "n")
    sent = spark.sparkContext.broadcast(row_filter(wanted))
    rescanned = source.select(F.xxhash64("id").alias("h"), "text").mapInArrow(_sets(width, sent), "node binary, `set` array<bigint>")
    sets = work.save(rescanned.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    # Stars first.
    pairs = buckets.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("bigint")
    links = both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")
    star = components(links, work, "star")
    # Then what is still apart, in blocks.
    links = _across(_still_apart(buckets, star, sets, work, percent), sets, work, percent)
    links = links.join(star.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(star.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    last = components(links.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), work, "last")
    labels = star.unionByName(last.join(star.select("node"), "node", "left_anti").select("node", F.col("node").alias("label")))
    labels = labels.join(last.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    placed = signed.select("row", "id", "text_key", "n", "node").join(labels, "node", "left").select("row", "id", "text_key", "n", F.coalesce("label", "node").alias("label"))
    placed = work.save(placed, "placed")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    groups = work.save(placed.where("label is not null").groupBy("label").agg(best), "best")
    work.keep("placed", "best")
    out = placed.join(groups, "label", "left")
    own = F.col("label").isNull()
    return out.select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        F.when(own, F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
        (own | (F.col("row") == F.col("best.row"))).alias("kept"),
        *([F.col("text_key")] if with_text_key else []),
    )


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all columns.

    Verdicts are found again by id and text; of rows in which both repeat as many
    stay as were kept.
    """
    found = near_duplicates(docs.select(doc_id, text), doc_id=doc_id, text=text, with_text_key=True, **limits)
    key = id_key(docs, doc_id)
    kept = found.where("kept").select(key.alias("_id"), F.col("text_key").alias("_key")).groupBy("_id", "_key").agg(F.count("*").alias("_copies"))
    # The table's own columns travel as one, so that no name of theirs meets one of these.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_kept"), key.alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"))
    joined = own.join(kept, ["_id", "_key"])
    number = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_id"))
    return joined.withColumn("_number", number).where("_number <= _copies").select(*(F.col(f"_kept.`{c}`").alias(c) for c in docs.columns))


def _across(placed: DataFrame, sets: DataFrame, work: Workspace, percent: int) -> DataFrame:
    """Links between different parts of a bucket: members in blocks, each block with each that may have links to it.

    A part with more members in a bucket than a block holds has blocks of its
    own, which aren't compared with each other.
    """
    sized = placed.join(sets.select("node", F.size("set").alias("values")), "node")
    sized = work.save(sized, "sized")
    parts = work.save(sized.groupBy("bucket", "label").agg(F.count("*").alias("members")), "parts")
    sized = sized.join(parts, ["bucket", "label"]).withColumn("own", F.when(F.col("members") > BLOCK, F.col("label")))
    total = sized.groupBy("bucket", "own").agg(F.count("*").alias("members"), F.sum("values").alias("values"))
    total = total.select("bucket", "own", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("values") / BLOCK_VALUES)).alias("blocks"))
    total = work.save(total, "total")
    put = sized.drop("members").join(total, (sized["bucket"] == total["bucket"]) & sized["own"].eqNullSafe(total["own"])).drop(total["bucket"]).drop(total["own"])
    put = put.select("node", "label", F.struct("bucket", "own", F.pmod(F.xxhash64("node", "bucket"), "blocks").alias("number")).alias("block"))
    put = work.save(put, "put")
    blocks = put.join(sets, "node").groupBy("block").agg(F.collect_list(F.struct("node", "label", "set")).alias("members"))
    blocks = work.save(blocks, "blocks")
    names = blocks.select("block", F.col("block.bucket").alias("bucket"))
    other = names.select(F.col("block").alias("other"), "bucket")
    apart = ~(F.col("block.own").isNotNull() & F.col("block.own").eqNullSafe(F.col("other.own")))
    order = F.to_json("block") <= F.to_json("other")
    pairs = names.join(other, "bucket").where(apart & order).select("block", "other")
    one = pairs.join(blocks.select("block", F.col("members").alias("x")), "block")
    two = one.join(blocks.select(F.col("block").alias("other"), F.col("members").alias("y")), "other").select("x", "y")
    return work.save(two.mapInArrow(_block_links(percent), "a binary, b binary"), "across")
