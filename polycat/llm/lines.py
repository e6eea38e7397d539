"""Lines that many documents share: kept once, dropped elsewhere.

Each long line gives a row (hash of its key, document, position).  The rows are
range-partitioned by hash and document, so that a line of any frequency is dealt
over as many partitions as it needs, and sorted by hash, document (largest
first) and position.  One streaming pass finds each line's first document and
counts the others; only lines at the edges of a partition (two at most in each)
wait for what the neighbours saw.  The result is a compressed bitmap of the lines
that a document keeps, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polycat.llm.arrays import LONG_BYTES, LOWER, SPACE, STEP_BYTES, is_long, pieces, sliced, steps, text_bytes
from polycat.llm.filters import marked, row_filter
from polycat.llm.shared import NO_ID, Workspace, id_key, numbered, partitions

def line_keys(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row, position in the text and 128-bit hash of each line whose key has ``least`` code points or more."""
    cut = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    # An empty text and the text after it begin at the same byte: count lines by text.
    lines = np.bincount(np.searchsorted(offsets, cut, "right") - 1, minlength=len(offsets) - 1) + 1
    row = np.repeat(np.arange(len(offsets) - 1), lines)
    first = np.cumsum(lines) - lines
    position = np.arange(len(row)) - first[row]
    end = np.empty_like(begin)
    last = first + lines - 1
    inner = np.ones(len(row), bool)
    inner[last] = False
    end[inner] = cut
    end[last] = offsets[1:]
    solid = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    some = np.flatnonzero(b > a)
    lo, hi = solid[a[some]], solid[b[some] - 1] + 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long = points[hi] - points[lo] >= least
    some, lo, hi = some[long], lo[long], hi[long]
    raw = memoryview(LOWER[data].tobytes())
    digest = [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
    return row[some], position[some], digest


NEW_LINE = np.zeros(256, dtype=bool)
NEW_LINE[0x0A] = True


def long_line_key(data: np.ndarray, least: int) -> bytes | None:
    """The hash of the key of one long line, or None where the key is too short; nothing of its length is made but the line itself."""
    edges = []
    for forward in (data, data[::-1]):
        at = 0
        while at < len(data) and SPACE[forward[at : at + STEP_BYTES]].all():
            at += STEP_BYTES
        edges.append(min(at + int((~SPACE[forward[at : at + STEP_BYTES]]).argmax()), len(data)) if at < len(data) else len(data))
    data = data[edges[0] : len(data) - edges[1]] if edges[0] < len(data) else data[:0]
    points, digest = 0, hashlib.blake2b(digest_size=16)
    for a in range(0, len(data), STEP_BYTES):
        part = data[a : a + STEP_BYTES]
        points += int(((part & 0xC0) != 0x80).sum())
        digest.update(LOWER[part])
    return digest.digest() if points >= least and len(data) else None


def long_text_keys(data: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """The same as ``line_keys`` of one long text, piece by piece; a piece ends with its last line."""
    before = 0
    for a, b in pieces(data, NEW_LINE):
        # Pieces end before a line break, which begins the next one.
        piece = data[a + (a > 0) : b]
        if len(piece) > 2 * LONG_BYTES:
            breaks = np.flatnonzero(piece == 0x0A)
            begin, end = np.append(0, breaks + 1), np.append(breaks, len(piece))
            keys = [(k, long_line_key(piece[x:y], least)) for k, (x, y) in enumerate(zip(begin.tolist(), end.tolist(), strict=True))]
            position, digest = [k for k, d in keys if d is not None], [d for _, d in keys if d is not None]
            yield np.zeros(len(position), np.int64), np.array(position, np.int64) + before, digest
            before += len(begin)
            continue
        row, position, digest = line_keys(piece, np.array([0, len(piece)]), least)
        yield row, position + before, digest
        before += int((piece == 0x0A).sum()) + 1


def _occurrences(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b, row, position, digest in _line_steps(data, offsets, least):
                h = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(position.astype(np.int32))], names=["h1", "h2", "doc", "tid", "pos"])

    return run


def _line_steps(data: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple]:
    for a, b in steps(offsets):
        text, off = sliced(data, offsets, a, b)
        for found in long_text_keys(text, least) if is_long(off) else [line_keys(text, off, least)]:
            yield a, b, *found


DROP, WAIT, EDGE = 0, 1, 2
FOUND = "kind tinyint, h1 bigint, h2 bigint, doc bigint, tid bigint, pos int, docs bigint"


def _found(kind: int, rows: np.ndarray, docs: int | None = None) -> pa.RecordBatch:
    n = len(rows)
    arrays = [pa.array(np.full(n, kind, np.int8)), *(pa.array(rows[c]) for c in ("h1", "h2", "doc", "tid")), pa.array(rows["pos"].astype(np.int32)), pa.array([docs] * n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "h1", "h2", "doc", "tid", "pos", "docs"])


ROW = np.dtype([("h1", "i8"), ("h2", "i8"), ("doc", "i8"), ("tid", "i8"), ("pos", "i8")])


def _stream(copies: int):
    """First occurrences of a sorted partition.  In memory at a time: a batch, and lines of fewer than ``copies`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, top, last, edge = np.zeros(0, ROW), 0, 0, 0, True  # of the line that is open
        key = None

        def close(final: bool) -> Iterator[pa.RecordBatch]:
            if key is not None and (edge or final):
                yield _found(WAIT, held)
                mark = np.zeros(1, ROW)
                mark["h1"], mark["h2"], mark["doc"] = *key, top
                yield _found(EDGE, mark, docs)

        for batch in batches:
            rows = np.zeros(batch.num_rows, ROW)
            for k, c in enumerate(ROW.names):
                rows[c] = batch.column(k).to_numpy(zero_copy_only=False)
            if not len(rows):
                continue
            new = np.ones(len(rows), bool)
            new[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
            begin = np.append(np.flatnonzero(new), len(rows))
            other = new.copy()
            other[1:] |= rows["doc"][1:] != rows["doc"][:-1]
            # Lines that begin and end in this batch, all at once.
            run_of = np.cumsum(new) - 1
            n = np.bincount(run_of, other)
            first = rows["doc"][begin[:-1]][run_of]
            whole = np.ones(len(begin) - 1, bool)
            whole[[0, -1]] = False
            out = whole[run_of] & (n[run_of] >= copies) & (rows["doc"] != first)
            if out.any():
                yield _found(DROP, rows[out])
            for r in dict.fromkeys((0, len(begin) - 2)):
                part = rows[begin[r] : begin[r + 1]]
                this = (int(part["h1"][0]), int(part["h2"][0]))
                if this != key:
                    yield from close(False)
                    edge = key is None
                    key, held, docs, top, last = this, np.zeros(0, ROW), 0, int(part["doc"][0]), None
                fresh = np.ones(len(part), bool)
                fresh[1:] = part["doc"][1:] != part["doc"][:-1]
                fresh[0] = last is None or int(part["doc"][0]) != last
                docs += int(fresh.sum())
                last = int(part["doc"][-1])
                if edge:
                    yield _found(WAIT, part)
                    continue
                part = part[part["doc"] != top]
                if docs >= copies:
                    yield _found(DROP, np.concatenate([held, part]))
                    held = np.zeros(0, ROW)
                else:
                    held = np.concatenate([held, part])
        yield from close(True)

    return run


def shared_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 40, copies: int = 5) -> DataFrame:
    """Which lines each document keeps.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased.  Keys of ``least`` code points or more that ``copies`` documents
    or more have lose all their lines but those of the largest id.  Returns a row
    for each distinct (id, text): the id, ``text_key`` (xxhash64 of the text),
    ``n_lines``, ``n_dropped`` and ``keep``, a zlib-compressed bitmap with a bit for
    each line, first line first, or null if all lines stay.  A null or empty text
    is one empty line.  Rows with one id are one document when copies are
    counted; a null id counts as one document smaller than all others.  Ids that
    aren't integers are ordered as Spark orders them.  No rows give none; other
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lines")
    kind = docs.schema[doc_id].dataType.simpleString()
    numbers = numbered(docs, doc_id)
    if numbers is None:
        source = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc"), _text_key(text).alias("tid"), F.col(text).alias("text"))
    else:
        numbers = work.save(numbers.select(F.col(doc_id).alias("_name"), F.col("number").cast("bigint").alias("_number")), "numbers")
        source = docs.select(F.col(doc_id).alias("_name"), F.col(text).alias("text")).join(numbers, "_name", "left").select(F.coalesce("_number", F.lit(NO_ID)).alias("doc"), _text_key("text").alias("tid"), "text")
    seen = work.save(source.mapInArrow(_occurrences(least), "h1 bigint, h2 bigint, doc bigint, tid bigint, pos int"), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    dealt = seen.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "tid", "pos")
    found = work.save(dealt.mapInArrow(_stream(copies), FOUND), "found")
    # Two rows a partition at most.
    edges = found.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("doc").alias("top")).where(F.col("n") >= copies)
    waited = found.where(F.col("kind") == WAIT).join(F.broadcast(edges), ["h1", "h2"]).where("doc <> top")
    gone = found.where(F.col("kind") == DROP).select("doc", "tid", "pos").unionByName(waited.select("doc", "tid", "pos"))
    gone = gone.groupBy("doc", "tid").agg(F.collect_set("pos").alias("gone"))
    whole = F.coalesce("text", F.lit(""))
    lines = F.length(whole) - F.length(F.translate(whole, "\n", "")) + 1
    each = source.select("doc", "tid", lines.cast("bigint").alias("n_lines")).groupBy("doc", "tid").agg(F.first("n_lines").alias("n_lines"))
    marked = each.join(gone, ["doc", "tid"], "left").select("doc", "tid", "n_lines", F.coalesce(F.size("gone").cast("bigint"), F.lit(0).cast("bigint")).alias("n_dropped"), "gone")
    out = marked.mapInArrow(_bitmaps, "doc bigint, tid bigint, n_lines bigint, n_dropped bigint, keep binary")
    if numbers is None:
        out = out.withColumn("_name", F.when(F.col("doc") != NO_ID, F.col("doc")).cast(kind))
    else:
        out = out.join(numbers.withColumnRenamed("_number", "doc"), "doc", "left")
    return out.select(F.col("_name").alias(doc_id), F.col("tid").alias("text_key"), "n_lines", "n_dropped", "keep")


def _text_key(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for n, gone in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if gone:
                bits = np.ones(n, np.uint8)
                bits[gone] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            else:
                keep.append(None)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(keep, pa.binary())], names=["doc", "tid", "n_lines", "n_dropped", "keep"])


def kept_text(data: np.ndarray, keep: bytes) -> bytes:
    """The bytes of a text without the lines that its bitmap drops; runs of lines that stay are copied whole."""
    cut = np.flatnonzero(data == 0x0A)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(cut) + 1)
    begin, end = np.append(0, cut + 1), np.append(cut, len(data))
    edge = np.diff(np.concatenate([[0], bits, [0]]).astype(np.int8))
    raw = memoryview(np.ascontiguousarray(data))
    return b"\n".join(raw[begin[x] : end[y - 1]] for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the texts that the bitmaps leave, all rows and columns; counts as ``_n_lines`` and ``_n_dropped``.

    Only bitmaps that drop lines are joined, and only rows whose text may have one are
    shuffled for it, by a filter of the texts' hashes (of a bounded size: beyond some million bitmaps more rows
    pass); all other rows stay where and as they are, also
    such that the bitmaps don't know, and no rows give none.  Columns of the two names are replaced.
    """
    docs = docs.drop("_n_lines", "_n_dropped")
    others = [c for c in docs.columns if c != text]
    marks = bitmaps.where(F.col("keep").isNotNull()).select(id_key(bitmaps, doc_id).alias("_id"), F.col("text_key").alias("_key"), "n_dropped", "keep")
    marks = Workspace(docs.sparkSession, "lines").save(marks, "bitmaps")  # a hot text's rows can be split
    may = marked(docs.sparkSession.sparkContext.broadcast(row_filter(marks, "_key")))
    lines = F.coalesce(F.length("_text") - F.length(F.translate("_text", "\n", "")), F.lit(0)) + 1
    # The table's own columns travel as one, so that no name of theirs meets one of these.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_kept"), F.col(text).alias("_text"), id_key(docs, doc_id).alias("_id"), _text_key(text).alias("_key"))
    tried = own.withColumn("_may", may(F.xxhash64("_key")))
    # Merged at every size: what is shuffled grows with the rows that lose lines, and with nothing else.
    joined = tried.where("_may").join(marks.hint("merge"), ["_id", "_key"], "left").select("_kept", "_text", lines.cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"), "keep")
    rest = tried.where("not _may").select("_kept", "_text", lines.cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, texts, lines, dropped, keep = batch.columns
            some = np.flatnonzero(~keep.is_null().to_numpy(zero_copy_only=False))
            if len(some):
                data, offsets = text_bytes(texts)
                mask = np.zeros(len(texts), bool)
                mask[some] = True
                left = [kept_text(data[offsets[k] : offsets[k + 1]], keep[k].as_py()) for k in some.tolist()]
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(left, pa.binary()).view(pa.string()).cast(texts.type))
            yield pa.RecordBatch.from_arrays([rest, texts, lines, dropped], names=["_kept", "_text", "n_lines", "n_dropped"])

    out = joined.mapInArrow(run, joined.drop("keep").schema).unionByName(rest)
    columns = [F.col("_text").alias(c) if c == text else F.col(f"_kept.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns, F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"))
