"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on an Arrow string column seen as one byte array plus
row offsets, a bounded slice at a time, so memory never follows the size of a
partition.  A null text reads as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on (one longer text is a step of its own).
STEP_BYTES = 2 << 20

#: Bytes from which on one text is worked on in pieces, so that memory doesn't follow its length.
LONG_BYTES = 4 << 20

#: ASCII white space as the contracts define it: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (one more than rows, the first 0)."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def valid(column: pa.Array) -> pa.Array:
    """A string column whose bytes that aren't UTF-8 are replaced by U+FFFD, as lenient reading does."""
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.large_binary()).to_pylist()], column.type)


def pieces(data: np.ndarray, separators: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` that cover one text and end before a separator, so that no word is cut; a longer word is in one of them."""
    at, n, limit = 0, len(data), limit or LONG_BYTES
    while at < n:
        end = min(at + limit, n)
        while end < n:
            hit = separators[data[end : end + (1 << 16)]]
            if hit.any():
                end += int(hit.argmax())
                break
            end = min(end + len(hit), n)
        yield at, end
        at = end


def is_long(offsets: np.ndarray) -> bool:
    """Whether a step is one text that is worked on in pieces."""
    return len(offsets) == 2 and offsets[1] > LONG_BYTES


def steps(offsets: np.ndarray, limit: int = STEP_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (or one row) and ``rows`` rows each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), at + rows, n)
        yield at, to
        at = to


def sliced(data: np.ndarray, offsets: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the rows from ``at`` up to ``to``."""
    off = offsets[at : to + 1]
    return data[off[0] : off[-1]], off - off[0]


def word_hashes(data: np.ndarray, separators: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the lower-cased words of one long text, piece by piece."""
    for a, b in pieces(data, separators):
        piece = LOWER[data[a:b]]
        yield Words(piece, np.array([0, b - a]), separators).hashes(piece)


#: Separators where punctuation shouldn't stick to words: every ASCII byte but letters and digits.
MARKS = np.zeros(256, dtype=bool)
MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True


class Words:
    """The words (runs of bytes that aren't separators) of a slice of texts.

    ``starts`` and ``ends`` are byte positions, ``doc`` the row of each word,
    ``first`` the index of the first word of each row (one more than rows).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.rows = len(offsets) - 1
        solid = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty_like(solid)
        if len(data):
            before[0] = False
            before[1:] = solid[:-1]
        after = np.empty_like(solid)
        if len(data):
            after[-1] = False
            after[:-1] = solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, offsets, "left")
        self._solid = solid

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word's bytes: multilinear over fixed position keys, then mixed."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        begin = np.cumsum(lens) - lens
        keys = mix(np.arange(int(lens.max()) + 1, dtype=np.uint64), 7) | np.uint64(1)
        at = np.arange(int(lens.sum())) - np.repeat(begin, lens)
        terms = keys[at]
        terms *= data[self._solid].astype(np.uint64) + np.uint64(1)
        return mix(np.add.reduceat(terms, begin) + lens.astype(np.uint64))
