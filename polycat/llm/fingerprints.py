"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is a polynomial in its bytes, modulo 2^31 - 1, at four
points.  Chunks are hashed side by side and combined by length-shifted
arithmetic, H(AB) = H(A) + r^|A| H(B), so one long text costs no more than many
short ones.  Texts that share fingerprint and length are then compared with the
first of them chunk by chunk in a streaming merge join; those that differ (none,
unless fingerprints collide) go through the same again among themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polycat.llm.arrays import LONG_BYTES, SPACE, is_long, sliced, steps, text_bytes
from polycat.llm.filters import bit_filter, passes
from polycat.llm.shared import Workspace

MODULUS = (1 << 31) - 1
#: Points of evaluation; any four numbers below the modulus do.
POINTS = (1202386181, 467118533, 1950346841, 831207671)
CHUNK = 1024
COMPARED = 1 << 16  # bytes of a chunk in the comparison


def collapsed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of white space of each text replaced by one space."""
    space = SPACE[data]
    again = np.zeros_like(space)
    again[1:] = space[1:] & space[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    again[inner] = False
    keep = ~again
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return np.where(space, np.uint8(0x20), data)[keep], before[offsets]


def _powers(base: int, n: int, modulus: int) -> np.ndarray:
    """base^0 to base^(n-1), by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, modulus)) % np.uint64(modulus)
        have += more
    return out[:n]


def combine(first: int, length: int, second: int, point: int, modulus: int = MODULUS) -> int:
    """The hash of two texts in a row from their hashes and the length of the first."""
    return (first + pow(point, length, modulus) * second) % modulus


def fingerprints(data: np.ndarray, offsets: np.ndarray, points: tuple = POINTS, modulus: int = MODULUS) -> np.ndarray:
    """A row of hashes for each text."""
    lens = np.diff(offsets)
    out = np.zeros((len(lens), len(points)), np.uint64)
    chunks = -(-lens // CHUNK)
    total = int(chunks.sum())
    if not total:
        return out
    owner = np.repeat(np.arange(len(lens)), chunks)
    number = np.arange(total) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = offsets[:-1][owner] + number * CHUNK
    at = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
    values = data.astype(np.uint64) + np.uint64(1)
    first = np.flatnonzero(number == 0)
    some = np.flatnonzero(chunks)
    m = np.uint64(modulus)
    for k, point in enumerate(points):
        parts = np.add.reduceat(values * _powers(point, CHUNK, modulus)[at], begin) % m
        shifts = _powers(pow(point, CHUNK, modulus), int(chunks.max()), modulus)[number]
        parts = parts * shifts % m
        # Sums of fewer than 2^32 numbers below 2^31 fit.
        out[some, k] = np.add.reduceat(parts, first) % m
    return out


def _packed(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prints = prints.astype(np.int64)
    return (prints[:, 0] << 31) | prints[:, 1], (prints[:, 2] << 31) | prints[:, 3]


def collapsed_parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """One long text, collapsed, a part at a time."""
    space = False
    for a in range(0, len(data), LONG_BYTES):
        part = data[a : a + LONG_BYTES]
        text, _ = collapsed(part, np.array([0, len(part)]))
        yield text[1:] if space and text[0] == 0x20 else text
        space = bool(SPACE[part[-1]])


def long_fingerprint(data: np.ndarray, points: tuple, modulus: int) -> tuple[np.ndarray, int, str]:
    """Hashes, length and SHA-256 of one long text: its parts' hashes combined."""
    whole, n, sha = [0] * len(points), 0, hashlib.sha256()
    for text in collapsed_parts(data):
        part = fingerprints(text, np.array([0, len(text)]), points, modulus)[0].tolist()
        whole = [combine(h, n, x, p, modulus) for h, x, p in zip(whole, part, points, strict=True)]
        n += len(text)
        sha.update(text)
    return np.array([whole], np.uint64), n, sha.hexdigest()


def hashed(data: np.ndarray, offsets: np.ndarray, points: tuple, modulus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str] | None, tuple | None]:
    """Packed hashes and lengths of the texts of a step; their digests where it is one long text, else the collapsed texts."""
    if is_long(offsets):
        prints, n, sha = long_fingerprint(data, points, modulus)
        return *_packed(prints), np.array([n]), [sha], None
    text, off = collapsed(data, offsets)
    return *_packed(fingerprints(text, off, points, modulus)), np.diff(off), None, (text, off)


def _digests(points: tuple, modulus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in steps(offsets):
                one, two, n, sha, texts = hashed(*sliced(data, offsets, a, b), points, modulus)
                if sha is None:
                    raw, off = memoryview(texts[0]), texts[1]
                    sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(one), pa.array(two), pa.array(n), pa.array(sha, pa.string())], names=["row", "id", "f1", "f2", "n", "sha"])

    return run


def _chunks(points: tuple, modulus: int, sent):
    """The chunks of each text whose fingerprint may be repeated; none that is gets lost."""
    names = ["id", "f1", "f2", "n", "sha", "part", "chunk"]

    def long_chunks(who: pa.Array, one: np.ndarray, two: np.ndarray, n: np.ndarray, sha: list[str], data: np.ndarray) -> Iterator[pa.RecordBatch]:
        part, rest = 0, np.zeros(0, np.uint8)

        def table(text: np.ndarray) -> pa.RecordBatch:
            some = [text[x : x + COMPARED].tobytes() for x in range(0, len(text), COMPARED)]
            same = np.zeros(len(some), np.int64)
            arrays = [who.take(pa.array(same)), *(pa.array(v[same]) for v in (one, two, n)), pa.array(sha * len(some), pa.string()), pa.array(np.arange(part, part + len(some), dtype=np.int32)), pa.array(some, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for text in collapsed_parts(data):
            rest = np.concatenate([rest, text])
            whole = len(rest) - len(rest) % COMPARED
            if whole:
                yield table(rest[:whole])
                part, rest = part + whole // COMPARED, rest[whole:]
        if len(rest):
            yield table(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in steps(offsets):
                one, two, n, long, texts = hashed(*sliced(data, offsets, a, b), points, modulus)
                some = np.flatnonzero(passes(sent.value, one, two))
                if long is not None:
                    if len(some):
                        yield from long_chunks(batch.column(0)[a:b], one, two, n, long, data[offsets[a] : offsets[b]])
                    continue
                raw, off = memoryview(texts[0]), texts[1]
                who, sha, part, chunk = [], [], [], []
                for k in some.tolist():
                    begin, end = int(off[k]), int(off[k + 1])
                    whole = hashlib.sha256(raw[begin:end]).hexdigest()
                    for p, x in enumerate(range(begin, max(end, begin + 1), COMPARED)):
                        who.append(k), sha.append(whole), part.append(p), chunk.append(bytes(raw[x : min(x + COMPARED, end)]))
                some = np.array(who, np.int64)
                columns = [batch.column(0)[a:b].take(pa.array(some)), pa.array(one[some]), pa.array(two[some]), pa.array(n[some])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sha, pa.string()), pa.array(part, pa.int32()), pa.array(chunk, pa.binary())], names=names)

    return run


KEY = ["f1", "f2", "n"]


def _first():
    """The row that stands for a group: of the smallest id, a null id last; texts that share an id are told apart by their digests."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha")).alias("first")


def _differing(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests of the texts that have a chunk unlike that of the first text of their group."""
    members = chunks.join(groups.select(*KEY, "first"), KEY)
    first = members.where(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("sha") == F.col("first.sha"))).select(*KEY, "part", "chunk")
    return members.join(first, [*KEY, "part", "chunk"], "left_anti").select(*KEY, "sha").distinct()


def exact_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", points: tuple = POINTS, modulus: int = MODULUS) -> DataFrame:
    """For each row of ``docs`` which row with an equal text stays.

    Returns the id, ``keep_id`` (the id of the row that stays), ``group_size``
    (rows with that text), ``kept`` and ``text_sha256`` (of the text with each run
    of white space replaced by a space).  A null text counts as empty, and all
    empty texts are equal.  Exactly one row of each group is kept, also where
    rows repeat: of rows with the smallest id, one of them; a null id comes after
    all others.  No rows give none; other columns of ``docs`` are not read.  A long text is hashed and
    compared in parts; a worker holds it once or twice beside them.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact")
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    numbered = source.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    digests = work.save(numbered.mapInArrow(_digests(points, modulus), f"row bigint, id {kind}, f1 bigint, f2 bigint, n bigint, sha string"), "digests")
    groups = work.save(digests.groupBy(*KEY).agg(F.count("*").alias("size"), _first()).where("size > 1"), "groups")
    sent = spark.sparkContext.broadcast(bit_filter(groups.select(F.col("f1").alias("a"), F.col("f2").alias("b")), groups.count()))
    chunks = work.save(source.mapInArrow(_chunks(points, modulus, sent), f"id {kind}, f1 bigint, f2 bigint, n bigint, sha string, part int, chunk binary"), "chunks")
    rounds, key = [], list(KEY)
    differ = work.save(_differing(chunks, groups), "differ0")
    while differ.limit(1).count():
        # Equal fingerprints of different texts: those unlike the first form groups of their own.
        rounds.append(differ)
        left = chunks.join(differ, [*KEY, "sha"], "left_semi")
        differ = work.save(_differing(left, left.groupBy(*KEY).agg(_first())), f"differ{len(rounds)}")
    if rounds:
        level = rounds[0].withColumn("level", F.lit(1))
        for k, more in enumerate(rounds[1:], 2):
            level = level.unionByName(more.withColumn("level", F.lit(k)))
        level = level.groupBy(*KEY, "sha").agg(F.max("level").alias("level"))
        digests = digests.join(level, [*KEY, "sha"], "left").fillna(0, ["level"])
        key.append("level")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    # Written first, so that the join is one of two shuffles, of which Spark can split a hot group's.
    digests = work.save(digests, "levels") if rounds else digests
    groups = work.save(digests.groupBy(*key).agg(F.count("*").alias("group_size"), best.alias("best")), "best")
    work.keep("levels" if rounds else "digests", "best")
    found = digests.join(groups, key)
    return found.select(F.col("id").alias(doc_id), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))
