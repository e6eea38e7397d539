"""Document fingerprints: threshold-scaled sketches of shingles.

A shingle is a run of six code points; its hash is a number of 48 bits.  The
sketch of a text keeps every hash below a fixed fraction of that range, whatever
the length of the text, so a long text keeps more than a short one and a sketch
is a fair sample of the shingles: the sketch of two texts together comes from
their two sketches, and the share of a short text that lies in a very long one is
seen as well as the likeness of two equals.  So that short texts have something
to compare, the least ``FLOOR`` hashes are kept too; each sketch then knows all
hashes up to some bound (``Sketch.bound``), two are compared up to the smaller of
their bounds, and texts of ``FLOOR`` shingles or fewer are compared exactly.

Written as text, a sketch is a letter (``a``: all hashes of the text, ``s``: a
sample) and eight base64 digits for each hash, in ascending order.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polycat.llm.arrays import LONG_BYTES, mix, steps, text_bytes, valid
from polycat.llm.shared import Workspace, partitions

WIDTH = 6
BITS = 48
#: Hashes below this are kept: one in 128.
LIMIT = (1 << BITS) // 128
FLOOR = 64
#: Rows of a step at most: row and hash share 64 bits.
ROWS = 1 << (64 - BITS)
#: Factors of the places of a shingle, odd.
PLACES = mix(np.arange(WIDTH, dtype=np.uint64), 12) | np.uint64(1)
#: Code points of a long text that are hashed at a time.
PART = 1 << 20


class Sketch(NamedTuple):
    """Hashes in ascending order, and whether they are all that the text has."""

    hashes: np.ndarray
    whole: bool

    @property
    def bound(self) -> int:
        """Every hash of the text up to here is in the sketch."""
        return (1 << BITS) - 1 if self.whole else max(LIMIT - 1, int(self.hashes[-1]))

    def __str__(self) -> str:
        raw = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
        return ("a" if self.whole else "s") + b64encode(raw.tobytes()).decode()


def parse(shown: str) -> Sketch:
    """A sketch from its text."""
    raw = np.zeros((len(shown) // 8, 8), np.uint8)
    raw[:, 2:] = np.frombuffer(b64decode(shown[1:]), np.uint8).reshape(-1, 6)
    return Sketch(raw.view(">u8").ravel().astype(np.uint64), shown[0] == "a")


def merge(one: Sketch, two: Sketch) -> Sketch:
    """The sketch of the shingles of both."""
    known = _distinct(np.concatenate([one.hashes, two.hashes]))
    known = known[known <= min(one.bound, two.bound)]
    keep = known[: max(FLOOR, int(np.searchsorted(known, LIMIT)))]
    return Sketch(keep, one.whole and two.whole and len(keep) == len(known))


def compare(one: Sketch, two: Sketch) -> tuple[float, float]:
    """Likeness (shared shingles among those of either) and the share of the first text's shingles that the second has.

    Two texts without shingles are alike, one without is like no other and lies in each.
    """
    bound = min(one.bound, two.bound)
    a, b = (int(np.searchsorted(x.hashes, bound, "right")) for x in (one, two))
    both = len(np.intersect1d(one.hashes[:a], two.hashes[:b], assume_unique=True))
    return (both / (a + b - both) if a + b else 1.0), (both / a if a else 1.0)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """In ascending order, each once."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def code_points(data: np.ndarray) -> np.ndarray:
    """The code points of UTF-8."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _hashes(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle and its row; a text shorter than a shingle is one itself."""
    lens = np.diff(offsets)
    # A gap after each text, so that no shingle reaches into the next.
    begin = offsets[:-1] + np.arange(len(lens)) * (WIDTH - 1)
    spaced = np.zeros(len(points) + len(lens) * (WIDTH - 1), np.uint64)
    spaced[np.arange(len(points)) + np.repeat(begin - offsets[:-1], lens)] = points.astype(np.uint64) + np.uint64(1)
    count = np.where(lens > 0, np.maximum(lens - WIDTH + 1, 1), 0)
    row = np.repeat(np.arange(len(lens)), count)
    at = np.arange(len(row)) + np.repeat(begin - (np.cumsum(count) - count), count)
    total = np.zeros(max(0, len(spaced) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        total += spaced[k : k + len(total)] * PLACES[k]
    return mix(total[at]) >> np.uint64(64 - BITS), row


def sketches(points: np.ndarray, offsets: np.ndarray) -> list[Sketch]:
    """The sketches of fewer than 65,536 texts."""
    rows = len(offsets) - 1
    hashes, row = _hashes(points, offsets)
    keys = (row.astype(np.uint64) << np.uint64(BITS)) | hashes
    low = hashes < LIMIT
    few = _distinct(keys[low])
    counts = np.bincount((few >> np.uint64(BITS)).astype(np.int64), minlength=rows)
    short = counts < FLOOR
    # Texts with fewer low hashes than the floor: the least of all their hashes, which include the low ones.
    rest = _distinct(keys[short[row]])
    owner = (rest >> np.uint64(BITS)).astype(np.int64)
    distinct = np.bincount(owner, minlength=rows)
    place = np.arange(len(rest)) - np.repeat(np.cumsum(distinct) - distinct, distinct)
    some = np.sort(np.concatenate([few[~short[(few >> np.uint64(BITS)).astype(np.int64)]], rest[place < FLOOR]]))
    kept = np.where(short, np.minimum(distinct, FLOOR), counts)
    whole = np.where(short, distinct <= FLOOR, np.bincount(row, minlength=rows) == np.bincount(row[low], minlength=rows))
    ends = np.cumsum(kept)
    some &= np.uint64((1 << BITS) - 1)
    return [Sketch(some[a:b], w) for a, b, w in zip((ends - kept).tolist(), ends.tolist(), whole.tolist(), strict=True)]


def _one(points: np.ndarray) -> Sketch:
    return sketches(points, np.array([0, len(points)]))[0]


def _starts(data: np.ndarray) -> np.ndarray:
    """Where code points begin, and the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _counted(data: np.ndarray) -> int:
    """Code points of a long text."""
    return sum(int(np.count_nonzero((data[x : x + LONG_BYTES] & 0xC0) != 0x80)) for x in range(0, len(data), LONG_BYTES))


def _end(data: np.ndarray, count: int) -> int:
    """The byte after so many code points of a long text."""
    for x in range(0, len(data), LONG_BYTES):
        first = (data[x : x + LONG_BYTES] & 0xC0) != 0x80
        n = int(np.count_nonzero(first))
        if count < n:
            return x + int(np.flatnonzero(first)[count])
        count -= n
    return len(data)


def long_sketch(*parts: np.ndarray) -> Sketch:
    """The sketch of the text that the parts make, a piece at a time: shingles over a cut belong to the piece after it."""
    out, rest = Sketch(np.zeros(0, np.uint64), True), np.zeros(0, np.uint32)
    whole = True  # nothing hashed yet
    for data in parts:
        at = 0
        while at < len(data):
            end = min(at + PART, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            points = np.concatenate([rest, code_points(data[at:end])])
            if len(points) >= WIDTH:
                out, whole, rest = merge(out, _one(points)), False, points[len(points) - WIDTH + 1 :]
            else:
                rest = points
            at = end
    return _one(rest) if whole else out


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _shown(n: int, sha: str, own: Sketch, edited: Sketch, following: Sketch) -> tuple:
    near_edited, in_edited = compare(own, edited)
    near_next, in_next = compare(own, following)
    return n, sha, str(own), str(edited), near_edited, near_next, in_edited, in_next


def long_pair(text: np.ndarray, following: np.ndarray) -> tuple:
    """The results of one text and the next where one of them is long."""
    n = _counted(text)
    parts = text[: _end(text, n - n // 3)], following[: _end(following, n // 3)]
    sha = hashlib.sha256(parts[0])
    sha.update(parts[1])
    return _shown(n, sha.hexdigest(), long_sketch(text), long_sketch(*parts), long_sketch(following))


def neighbours(data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """The results of each text but the last, whose next one is the row after it."""
    raw, at = memoryview(np.ascontiguousarray(data)), _starts(data)
    points = code_points(data)
    off = np.searchsorted(at, offsets)
    lens = np.diff(off)
    cut = lens[:-1] // 3
    ends, more = off[1:-1] - cut, off[1:-1] + np.minimum(cut, lens[1:])
    own = sketches(points, off)
    first, last = off[:-2].tolist(), list(zip(ends.tolist(), off[1:-1].tolist(), more.tolist(), strict=True))
    edits = [x for a, (b, c, d) in zip(first, last, strict=True) for x in (points[a:b], points[c:d])]
    edited = sketches(np.concatenate(edits) if edits else points[:0], np.append(0, np.cumsum(ends - off[:-2] + more - off[1:-1])))
    out = []
    for k, (a, (b, c, d)) in enumerate(zip(first, last, strict=True)):
        sha = hashlib.sha256(raw[at[a] : at[b]])
        sha.update(raw[at[c] : at[d]])
        out.append(_shown(int(lens[k]), sha.hexdigest(), own[k], edited[k], own[k + 1]))
    return out


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


#: Kinds of rows of a pass: results, and the first and last text of a partition.
DONE, FIRST, LAST = 0, 1, 2


def _edge(kind: int, who: pa.Array, data: np.ndarray) -> pa.RecordBatch:
    empty = [pa.nulls(1, c.type) for c in _columns([])]
    return pa.RecordBatch.from_arrays([who, *empty, pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([kind], pa.int32()), pa.array([data.tobytes().decode()])], names=["id", *NAMES, "part", "kind", "text"])


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of the sorted texts of a partition; its last text waits for the next partition's first."""

    def done(who: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        same = [pa.nulls(n, pa.int32()), pa.array(np.full(n, DONE, np.int32)), pa.nulls(n, pa.string())]
        return pa.RecordBatch.from_arrays([who, *_columns(rows), *same], names=["id", *NAMES, "part", "kind", "text"])

    before = None  # id and bytes of the row whose next one hasn't come yet
    for batch in batches:
        data, offsets = text_bytes(valid(batch.column(1)))
        ids = batch.column(0)
        for a, b in steps(offsets, rows=ROWS - 2):
            some, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            who = ids[a:b]
            if before is None:
                yield _edge(FIRST, who[:1], some[: off[1]])
            elif len(before[1]) + len(some) > LONG_BYTES:
                yield done(before[0], [long_pair(before[1], some[: off[1]])])
            else:
                some, off = np.concatenate([before[1], some]), np.append(0, off + len(before[1]))
                who = pa.concat_arrays([before[0], who])
            if len(off) > 2:
                yield done(who[:-1], neighbours(some, off))
            before = pa.concat_arrays([who[-1:]]), some[off[-2] :].copy()
    if before is not None:
        yield _edge(LAST, *before)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            text, following = (text_bytes(batch.column(c)[k : k + 1])[0] for c in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], *_columns([long_pair(text, following)])], names=["id", *NAMES])


def with_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprint of each text, and how like it are an edited text and the next document.

    The next document is the one with the next smaller id (after the last: the
    first); the edited text has the last third of the code points, rounded down,
    replaced by as many from the start of the next document, or all that it has.
    Returns a row for each row: the id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next`` (likeness
    of the fingerprint to that of the edited text and of the next document), and
    ``contained_edited`` and ``contained_next`` (how much of the text lies in them).

    A null text is the empty text; texts without a code point are alike and like
    no other.  A null id comes after all others.  Rows with one id are ordered by
    a hash of their texts, rows that repeat stand next to each other.  A row
    alone is its own next document.  Bytes that aren't UTF-8 read as U+FFFD.  No
    rows give none; other columns aren't read.

    The texts are dealt once, by ranges of ids (and of hash and row where an id
    repeats), and each partition is read in order; two texts of each partition,
    its first and its last, are joined afterwards.  A text over 4 MB is hashed in
    parts; a task holds two texts and their sketches.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "sketches")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("id").desc_nulls_last(), F.col("tie"), F.col("row")]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("id", "text")
    seen = work.save(dealt.mapInArrow(_pass, f"id {kind}, {RESULT}, part int, kind int, text string"), "pass")
    last = seen.where(F.col("kind") == LAST).select("part", "id", "text")
    first = seen.where(F.col("kind") == FIRST).select(F.col("part").alias("_part"), F.col("text").alias("following"))
    # Numbers of partitions that have rows: no more than there are partitions.
    parts = sorted(r["part"] for r in last.select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, _part int")
    edges = last.join(F.broadcast(after), "part").join(first, "_part").select("id", "text", "following").mapInArrow(_pairs, f"id {kind}, {RESULT}")
    out = seen.where(F.col("kind") == DONE).select("id", *NAMES).unionByName(edges)
    return out.withColumnRenamed("id", doc_id)


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ``fingerprint``) of each row of ``docs``, without any shuffle; null and empty texts have none of the hashes."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(valid(batch.column(1)))
            for a, b in steps(offsets, rows=ROWS - 1):
                some, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                made = [long_sketch(some)] if len(some) > LONG_BYTES else sketches(code_points(some), np.searchsorted(_starts(some), off))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(map(str, made), pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", doc_id)


def compared(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """``pairs`` of fingerprints with ``likeness`` and ``contained`` (how much of the first text the second has); null where a fingerprint is."""
    shown = pairs.drop("likeness", "contained")
    # The table's own columns travel as one, so that no name of theirs meets one of these.
    rows = shown.select(F.struct(*(F.col(f"`{c}`") for c in shown.columns)).alias("kept"), F.col(f"`{one}`").alias("one"), F.col(f"`{two}`").alias("two"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            made = [(None, None) if a is None or b is None else compare(parse(a), parse(b)) for a, b in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in made], pa.float64()) for k in (0, 1))], names=["kept", "likeness", "contained"])

    schema = rows.select("kept", F.lit(None).cast("double").alias("likeness"), F.lit(None).cast("double").alias("contained")).schema
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(f"kept.`{c}`").alias(c) for c in shown.columns), "likeness", "contained")
