"""Benchmark passages in documents, also paraphrased, by latent semantic retrieval.

Words are hashed to features and weighed by inverse document frequency over all
documents.  A randomised SVD of the TF-IDF passages of all documents and all
benchmark items (one distributed pass) gives a latent space.  Every window of every document around which an item's
rarest words stand is projected into it, and those whose cosine with the item is high, or that
have most of its words, are aligned with it by the longest common subsequence of words, the closest first.
A document leaks an item if the two share most words in order, or a good part of
them and the item's answer; where other words stand for many of the item's but the window is close to it in
the latent space, less of its words and the answer are enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from polycat.llm import arrays
from polycat.llm.arrays import MARKS, Words, pieces, sliced, steps, text_bytes, valid
from polycat.llm.filters import marked, row_filter
from polycat.llm.shared import Workspace

BITS = 15
RANK = 40
SIZES = (4, 8, 16, 32, 64)
PASSAGE = 32


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts in lower case, of any script; bytes that aren't UTF-8 read as U+FFFD."""
    return text_bytes(pc.utf8_lower(valid(column)))


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    words = Words(data, offsets, MARKS)
    return words, words.hashes(data)


def feature_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, texts = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        data, offsets = lowered(batch.column(0))
        texts += batch.num_rows
        for a, b in steps(offsets):
            words, h = hashed_words(*sliced(data, offsets, a, b))
            f = feature_of(h)
            order = np.argsort(f.astype(np.uint16), kind="stable")  # of one feature, words stay in the order of texts
            f, doc = f[order], words.doc[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
            total += np.bincount(f[new], minlength=len(total))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.append(texts, total))], names=["feature", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """The weight of each feature, from all rows of a column of texts."""
    got = texts.mapInArrow(_frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    n, at = got.column("n").to_numpy(), got.column("feature").to_numpy()
    df = np.zeros(1 << BITS)
    df[at[at >= 0]] = n[at >= 0]
    return (np.log((2 + n[at < 0].sum()) / (1 + df))).astype(np.float32)


def _passages(words: Words, h: np.ndarray, idf: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Unit TF-IDF rows of consecutive passages, as (first entry of each row, feature, weight), some at a time."""
    place = np.arange(len(h)) - words.first[words.doc]
    new = np.flatnonzero(place % size == 0)
    f = feature_of(h)
    for lo in range(0, len(new), 4096):
        a, b = new[lo], new[lo + 4096] if lo + 4096 < len(new) else len(h)
        first = new[lo : lo + 4096] - a
        w = idf[f[a:b]]
        norm = np.sqrt(np.add.reduceat(w * w, first))
        yield first, f[a:b], w / np.repeat(np.maximum(norm, 1e-9), np.diff(np.append(first, b - a)))


def _add_sketch(out: np.ndarray, rows: tuple, matrix: np.ndarray) -> None:
    """Add A'(A M) of some passages A to ``out``, which has a row for each column of M."""
    first, f, w = rows
    many = np.diff(np.append(first, len(f)))
    owner = np.repeat(np.arange(len(first)), many)
    # Passages side by side, filled up with words of no weight.
    place = owner * many.max() + np.arange(len(f)) - first[owner]
    feature, weight = np.zeros(len(first) * many.max(), np.int64), np.zeros(len(first) * many.max(), np.float32)
    feature[place], weight[place] = f, w
    y = np.matmul(weight.reshape(len(first), 1, -1), matrix.take(feature, axis=0).reshape(len(first), -1, matrix.shape[1]))[:, 0]
    w = w.astype(np.float64)
    for k, column in enumerate(np.ascontiguousarray(y.T, np.float64)):
        out[k] += np.bincount(f, column.take(owner) * w, out.shape[1])


#: Features whose sums travel together.
SLICE = 512


def _sketches(idf: np.ndarray, matrix: np.ndarray):
    """A'(A M) of the passages A of a partition, in slices of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(matrix.shape[::-1])
        for batch in batches:
            data, offsets = lowered(batch.column(0))
            for a, b in steps(offsets, 1 << 20):
                words, h = hashed_words(*sliced(data, offsets, a, b))
                for rows in _passages(words, h, idf, PASSAGE):
                    _add_sketch(out, rows, matrix)
        at = range(0, len(matrix), SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([out[:, k : k + SLICE].astype(np.float32).tobytes() for k in at], pa.binary())], names=["at", "part"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice of a partition that has all its parts."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[at] = total.get(at, 0.0) + np.frombuffer(part, np.float32).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["at", "part"])


def latent_space(texts: DataFrame, idf: np.ndarray, *, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """Right singular vectors (features x rank) of the TF-IDF passages of ``texts``, by a randomised range finder in one pass (Nystrom's way).

    Each task has a matrix of fixed size.  They are added up by slices of features in a
    shuffle of as many matrices as there are tasks: four for each core at most,
    whatever the input.  The driver gets the sum.
    """
    start = np.random.default_rng(seed).standard_normal((len(idf), rank)).astype(np.float32)
    parts = texts.coalesce(4 * texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(_sketches(idf, start), "at bigint, part binary")
    got = parts.repartition(-(-len(idf) // SLICE), "at").mapInArrow(_summed, "at bigint, part binary").toArrow()
    total = 1e-9 * start.astype(np.float64)
    for at, part in zip(got.column("at").to_pylist(), got.column("part").to_pylist(), strict=True):
        total[at : at + SLICE] += np.frombuffer(part).reshape(rank, -1).T
    q, r = np.linalg.qr(total)
    core = start.T @ total
    _, turn = np.linalg.eigh(r @ np.linalg.pinv((core + core.T) / 2, rcond=1e-6, hermitian=True) @ r.T)
    return (q @ turn[:, ::-1]).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word's worth of ``a`` at a time."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = masks.get(x, 0)
        if m:
            both = row & m
            row = (row + both) | (row - both)
            row &= full
    return len(a) - row.bit_count()


#: Cells of a table of items by words, up to which one is made.
MOST_CELLS = 1 << 26
#: Words of an answer from which on it tells a paraphrase whose other words are mostly not the item's: fewer, in a text of common words, may stand together by chance.
LONG_ANSWER = 10
#: Keys of an item that must be close together in a text, and keys found that are looked at together.
HITS = 3
MOST_HITS = 1 << 20


def _least(share: float, n: int) -> int:
    """How many of n words make up a share, one at least."""
    return max(1, math.ceil(share * n - 1e-9))


def _half(n):
    return (n + 1) // 2


def _end_of_text(words: Words, at: np.ndarray, lo: int, hi: int) -> int:
    """Where in ``at``, behind or else before ``hi``, a text ends, so that no text is cut."""
    if hi >= len(at):
        return len(at)
    doc = words.doc[at]
    cut = int(np.searchsorted(doc, doc[hi - 1]))
    return cut if cut > lo else int(np.searchsorted(doc, doc[hi - 1], "right"))


@dataclass
class Items:
    """A block of benchmark items: ids, word hashes, where the answer begins, and latent vectors by window size."""

    ids: list
    words: list
    answer: list
    vectors: np.ndarray
    size: np.ndarray

    def __post_init__(self):
        whole = np.concatenate([np.zeros(0, np.uint64), *self.words])
        self.vocabulary, number = np.unique(whole, return_inverse=True)
        bits = min(max(len(self.vocabulary).bit_length() + 3, 8), 20)
        self.lead_shift = np.uint64(64 - bits)
        self.lead_first = np.searchsorted((self.vocabulary >> self.lead_shift).astype(np.int64), np.arange((1 << bits) + 1))
        owner = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])
        self.pairs, self.times = np.unique(owner * len(self.vocabulary) + number, return_counts=True)
        self.pairs_first = np.searchsorted(self.pairs, np.arange(len(self.words) + 1) * len(self.vocabulary))
        self.table = None
        if len(self.words) * len(self.vocabulary) <= MOST_CELLS:
            self.table = np.zeros(len(self.words) * len(self.vocabulary), bool)
            self.table[self.pairs] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word in the items' vocabulary, or -1: words with the same leading bits are looked through."""
        out = np.full(len(h), -1)
        lead = (h >> self.lead_shift).astype(np.int64)
        at, end = self.lead_first.take(lead), self.lead_first.take(lead + 1)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.vocabulary[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def has(self, item: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether each item has the word of that number."""
        key = item * len(self.vocabulary) + number
        if self.table is not None:
            return self.table[np.maximum(key, 0)] & (number >= 0)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return (number >= 0) & (self.pairs[at] == key)

    def within(self, item: np.ndarray, left: np.ndarray, right: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of stretches of a text, laid side by side: where each stretch begins, the place of each word, whether it is its item's,
        and how many words stretch and item have in common, each as often as both have it.  No common subsequence is longer."""
        many = right - left
        base = np.cumsum(many) - many
        at = np.arange(int(many.sum())) - np.repeat(base - left, many)
        stretch = np.repeat(np.arange(len(item)), many)
        mine = self.has(item[stretch], number[at])
        which = stretch[mine]
        # The item's different words are counted, for one stretch after the other.
        own = self.pairs_first[item + 1] - self.pairs_first[item]
        shift = np.cumsum(own) - own - self.pairs_first[item]
        pair = np.searchsorted(self.pairs, item[which] * len(self.vocabulary) + number[at[mine]])
        found = np.bincount(pair + shift[which], minlength=int(own.sum()))
        have = self.times[np.arange(len(found)) - np.repeat(shift, own)]
        return base, at, mine, np.add.reduceat(np.minimum(found, have), np.cumsum(own) - own)


@dataclass
class Retriever:
    """What a task needs: feature weights, latent space, items, and the limits."""

    idf: np.ndarray
    space: np.ndarray
    items: Items
    close: float
    most: float
    part: float
    answered: float
    near: float
    far: float

    def __post_init__(self):
        """What the rule asks of each item, and its keys: words of which any leak has at least ``hits``.

        Where m of n words must be found, at most n - m are missing, so at least k of
        any n - m + k are found; the rarest ones are taken, for each way to leak.
        """
        self.space = self.space * self.idf[:, None]  # of a word as it counts in a window
        self.length = np.array([len(w) for w in self.items.words], np.int64)
        self.need, self.hits = np.zeros(len(self.length), np.int64), np.zeros(len(self.length), np.int64)
        self.least = np.zeros(len(self.length), np.int64)  # where the window is near
        word, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, w in enumerate(self.items.words):
            begin = self.items.answer[k]
            ways = [(0, _least(self.most, len(w)))]
            self.need[k] = ways[0][1]
            if begin < len(w):
                ways.append((begin, _least(self.answered, len(w) - begin)) if self.answered > 0 else (0, _least(min(self.part, self.far), len(w))))
                self.need[k] = min(self.need[k], _least(self.part, len(w)))
            self.least[k] = min(self.need[k], _least(self.far, len(w))) if len(w) - begin >= LONG_ANSWER else self.need[k]
            self.hits[k] = min(HITS, *(m for _, m in ways))
            for at, m in ways:
                rare = np.argsort(-self.idf[feature_of(w[at:])], kind="stable")
                word.append(w[at:][rare[: len(w) - at - m + self.hits[k]]])
                owner.append(np.full(len(word[-1]), k))
        number = self.items.numbers(np.concatenate(word))
        keys = np.unique(number * max(1, len(self.length)) + np.concatenate(owner))
        self.key_item = keys % max(1, len(self.length))
        self.key_first = np.searchsorted(keys // max(1, len(self.length)), np.arange(len(self.items.vocabulary) + 1))

    def project(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        v = np.add.reduceat(self.space.take(f, axis=0), first)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def zones(self, words: Words, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Item, and first and last word that is a key of it, of all stretches of a text with enough of the item's keys close together."""
        at = np.flatnonzero(number >= 0)
        n = np.diff(self.key_first)[number[at]]
        at, n = at[n > 0], n[n > 0]
        before = np.cumsum(n)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(before, (before[lo - 1] if lo else 0) + MOST_HITS, "right")))
            hi = _end_of_text(words, at, lo, hi)
            m = n[lo:hi]
            place = np.repeat(at[lo:hi], m)
            item = self.key_item[np.arange(len(place)) + np.repeat(self.key_first[number[at[lo:hi]]] - np.cumsum(m) + m, m)]
            order = np.argsort(item, kind="stable")
            place, item = place[order], item[order]
            reach = 2 * self.length[item] + self.items.size[item]
            new = np.ones(len(place), bool)
            new[1:] = (item[1:] != item[:-1]) | (words.doc[place[1:]] != words.doc[place[:-1]]) | (place[1:] - place[:-1] >= reach[1:])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place)) - 1
            enough = last - first + 1 >= self.hits[item[first]]
            yield item[first[enough]], place[first[enough]], place[last[enough]]
            lo = hi

    def windows(self, words: Words, h: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First word, size, item and cosine of all windows that have as many of an item's words in reach as the rule asks for."""
        f = feature_of(h)
        for item, a, b in self.zones(words, number):
            # Windows begin at every step-th word; the last one of a text ends with it.
            size, length = self.items.size[item], self.length[item]
            step = np.maximum(1, size // 4)
            start, end = words.first[words.doc[a]], words.first[words.doc[a] + 1]
            final = np.maximum(end - start - size, 0)
            lowest = np.minimum(np.maximum(a - start - size - length, 0) // step, -(-final // step))
            highest = np.minimum(-(-(b - start + length) // step), -(-final // step))
            n = highest - lowest + 1
            for some in np.array_split(np.arange(len(n)), 1 + int((n * step + 3 * length).sum()) // (1 << 20)):
                if not len(some):
                    continue
                # The words of each zone with all that its windows have around them, and which are the item's.
                left = np.maximum(np.minimum(lowest[some] * step[some], final[some]) - length[some], 0) + start[some]
                right = np.minimum(start[some] + highest[some] * step[some] + size[some] + length[some], end[some])
                base, _, mine, common = self.items.within(item[some], left, right, number)
                seen = np.append(0, np.cumsum(mine))
                hope = common >= self.least[item[some]]
                some, base, left = some[hope], base[hope], left[hope]
                zone = np.repeat(np.arange(len(some)), n[some])
                k = np.arange(len(zone)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]) + lowest[some][zone]
                which = some[zone]
                begin = start[which] + np.minimum(k * step[which], final[which])
                lo, hi = np.maximum(begin - length[which], start[which]), np.minimum(begin + size[which] + length[which], end[which])
                shift = base[zone] - left[zone]
                around = seen[hi + shift] - seen[lo + shift]
                keep = around >= self.least[item[which]]
                lo, hi = np.maximum(begin - _half(length[which]), start[which]), np.minimum(begin + size[which] + _half(length[which]), end[which])
                dense = (seen[hi + shift] - seen[lo + shift] >= self.need[item[which]])[keep]
                begin, which, enough = begin[keep], which[keep], (around >= self.need[item[which]])[keep]
                for lo in range(0, len(begin), 4096):
                    w, x = which[lo : lo + 4096], begin[lo : lo + 4096]
                    many = np.minimum(x + size[w], end[w]) - x
                    first = np.cumsum(many) - many
                    at = np.arange(int(many.sum())) - np.repeat(first - x, many)
                    cosine = (self.project(f[at], first) * self.items.vectors[item[w]]).sum(1)
                    ok = dense[lo : lo + 4096] | enough[lo : lo + 4096] & (cosine >= self.close) | (cosine >= self.near)
                    yield x[ok], size[w[ok]], item[w[ok]], cosine[ok]

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple]]:
        """(item, cosine, share of the item's words found in order, first word) of each item that each text leaks."""
        words, h = hashed_words(data, offsets)
        out: list[list[tuple]] = [[] for _ in range(words.rows)]
        if not len(h) or not self.items.ids:
            return out
        number = self.items.numbers(h)
        found = [x for x in self.windows(words, h, number) if len(x[0])]
        if not found:
            return out
        begin, size, item, cosine = (np.concatenate(c) for c in zip(*found, strict=True))
        owner = words.doc[begin]
        order = np.lexsort((begin, item, owner))
        begin, size, item, cosine, owner = (c[order] for c in (begin, size, item, cosine, owner))
        # Windows whose surroundings overlap: what all of them together don't have, none has.  They are aligned only
        # where they have enough words in common, and only the item's words are.
        new = np.ones(len(begin), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] >= 2 * self.length[item[1:]] + size[1:])
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(begin))
        of, text = item[first], owner[first]
        left = np.maximum(begin[first] - self.length[of], words.first[text])
        right = np.minimum(begin[ends - 1] + size[first] + self.length[of], words.first[text + 1])
        longest = np.zeros(len(first), np.int64)
        for some in np.array_split(np.arange(len(first)), 1 + int((right - left + self.length[of]).sum()) // (1 << 20)):
            if not len(some):
                continue
            base, at, mine, common = self.items.within(of[some], left[some], right[some], number)
            mine = np.flatnonzero(mine)
            cut = np.append(np.searchsorted(mine, base), len(mine))
            for k in np.flatnonzero(common >= self.least[of[some]]).tolist():
                longest[some[k]] = common_subsequence(self.items.words[of[some[k]]], h[at[mine[cut[k] : cut[k + 1]]]])
        hope = np.repeat(longest, ends - first) >= np.where(cosine >= self.near, self.least[item], self.need[item])
        begin, size, item, cosine, owner = (c[hope] for c in (begin, size, item, cosine, owner))
        best: dict[tuple[int, int], tuple] = {}
        for k in np.lexsort((-cosine, item, owner)).tolist():
            key = (int(owner[k]), int(item[k]))
            if key in best:
                continue
            mine = self.items.words[key[1]]
            reach = len(mine) if cosine[k] >= self.close else _half(len(mine))
            lo = max(int(begin[k]) - reach, int(words.first[key[0]]))
            hi = min(int(begin[k] + size[k]) + reach, int(words.first[key[0] + 1]))
            share = common_subsequence(mine, h[lo:hi]) / len(mine)
            if share * len(mine) < (self.least if cosine[k] >= self.near else self.need)[key[1]] - 1e-6:
                continue
            if share < self.most:
                answer = mine[self.items.answer[key[1]] :]
                if not len(answer) or common_subsequence(answer, h[lo:hi]) < self.answered * len(answer):
                    continue
            best[key] = (self.items.ids[key[1]], float(cosine[k]), share, int(begin[k] - words.first[key[0]]))
        for (row, _), what in best.items():
            out[row].append(what)
        return out


def long_leaks(block: Retriever, data: np.ndarray) -> list[tuple]:
    """``leaks`` of one long text, searched in pieces that overlap by as many words as a window and all around it may have."""
    overlap = int(2 * block.length.max(initial=0)) + max(SIZES)
    best: dict[tuple, tuple] = {}
    rest, base = data[:0], 0
    for a, b in pieces(data, MARKS, arrays.LONG_BYTES):
        part = np.concatenate([rest, data[a:b]])
        ends = np.array([0, len(part)])
        seen: dict = {}
        for item, cosine, share, start in block.leaks(part, ends)[0]:
            seen[item] = seen.get(item, 0) + 1
            key = item, seen[item]  # repeated items are each reported
            if key not in best or cosine > best[key][1]:
                best[key] = item, cosine, share, start + base
        starts = Words(part, ends, MARKS).starts
        # From a word on at which windows of all sizes begin.
        first = max(0, len(starts) - overlap) // max(SIZES) * max(SIZES)
        rest, base = (part[starts[first] :] if len(starts) else part[:0]), base + first
    return list(best.values())


def _items(rows: list[tuple], idf: np.ndarray, space: np.ndarray) -> Items:
    data, offsets = lowered(pa.array([t for _, t, _ in rows], pa.string()))
    words, h = hashed_words(data, offsets)
    answers = hashed_words(*lowered(pa.array([a for _, _, a in rows], pa.string())))
    ids, mine, begins, vectors, size = [], [], [], [], []
    for k, (item, _, answer) in enumerate(rows):
        w = h[words.first[k] : words.first[k + 1]]
        if not len(w):
            continue
        f = feature_of(w)
        v = (space[f] * idf[f][:, None]).sum(0)
        if answer is None:  # its last third
            begin = len(w) - -(-len(w) // 3)
        else:
            begin = len(w)
            w = np.concatenate([w, answers[1][answers[0].first[k] : answers[0].first[k + 1]]])
        ids.append(item), mine.append(w), begins.append(begin)
        vectors.append(v / max(float(np.linalg.norm(v)), 1e-9))
        size.append(max([s for s in SIZES if s <= len(f)], default=SIZES[0]))
    return Items(ids, mine, begins, np.array(vectors, np.float32).reshape(-1, space.shape[1]), np.array(size, np.int64))


#: Bytes of benchmark text that are looked for together, and blocks that one pass over the documents looks for.
BLOCK_BYTES, BLOCKS_A_PASS = 4 << 20, 4


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, sample: int | None = None, close: float = 0.55, most: float = 0.75, part: float = 0.55, answered: float = 0.8, near: float = 0.85, far: float = 0.4) -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, cosine, share, start), empty where nothing leaks.

    An item leaks if ``most`` of its words are found in order in reach of a window,
    or ``part`` of them and ``answered`` of its answer (the column ``answer``, else the
    last third of its words), or ``far`` of them and so much of its answer, if that has
    ten words or more, in reach of a window whose latent cosine with it is at least ``near``.  A window has up to as many words as the item; in
    reach are half as many words as the item has on either side, and as many as it
    has where the window's latent cosine with it is at least ``close``.  All windows
    with enough of the item's words in reach are aligned, those with the greatest
    cosine first.  Words are runs of letters, digits and non-ASCII bytes, in
    lower case.  The latent space and the word weights come from all documents (with
    ``sample``, the space from about so many, drawn by a hash of ``key`` and text, and all items), and all documents are
    searched whole.  The benchmark is looked for in blocks of bounded size, some in
    each pass over the documents, so that no worker holds more; several passes keep what they find by
    hashes of the texts, and only documents that may have leaked something are shuffled to be put together with it.

    A text over 4 MB is searched in pieces that overlap.  A null or empty text leaks nothing; no documents give none; null or empty items are ignored; repeated
    items are each reported and repeated rows all stay.  A column named ``leaks`` is
    replaced, all others are kept.
    """
    spark = docs.sparkSession
    docs = docs.drop("leaks")
    names = docs.columns
    texts = docs.select(F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer")).where("text is not null")
    idf = inverse_frequencies(texts)
    drawn = texts
    if sample is not None:
        share = min(1 << 20, -(-(sample << 20) // max(docs.count(), 1)))
        drawn = docs.where(F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(5)), F.lit(1 << 20)) < share).select(F.col(text).alias("text"))
    size = F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0)) + 16
    blocks = max(1, -(-int(items.agg(F.sum(size)).first()[0] or 0) // BLOCK_BYTES))
    space = latent_space(drawn.unionByName(items.select("text")), idf)
    item_kind = items.schema["item"].dataType
    kind = f"array<struct<item_id:{item_kind.simpleString()},cosine:double,share:double,start:bigint>>"
    leak = pa.list_(pa.struct([("item_id", to_arrow_type(item_kind)), ("cosine", pa.float64()), ("share", pa.float64()), ("start", pa.int64())]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    none = F.from_json(F.lit("[]"), kind)

    def block(number: int):
        mine = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).orderBy("item", "text").collect()]
        return spark.sparkContext.broadcast(Retriever(idf, space, _items(mine, idf, space), close, most, part, answered, near, far))

    if blocks <= BLOCKS_A_PASS:
        return docs.withColumn("leaks", none).mapInArrow(_search([block(k) for k in range(blocks)], names, text, leak), f"{fields}, leaks {kind}")
    # What a text leaks depends on the text alone: each pass keeps what it found by two hashes of the text.
    work = Workspace(spark, "leaks")
    one, two = (F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(k)) for k in (1, 2))
    passes_ = []
    for first in range(0, blocks, BLOCKS_A_PASS):
        sent = [block(k) for k in range(first, min(first + BLOCKS_A_PASS, blocks))]
        found = docs.select(one.alias("_one"), two.alias("_two"), F.col(text).alias("_text"), none.alias("_none")).mapInArrow(_search(sent, ["_one", "_two", "_text"], "_text", leak, only=True), f"_one bigint, _two bigint, leaks {kind}")
        passes_.append(work.save(found.dropDuplicates(["_one", "_two"]), f"pass-{first}"))
        for done in sent:
            done.unpersist()
    hits = reduce(DataFrame.unionByName, passes_).groupBy("_one", "_two").agg(F.sort_array(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    hits = work.save(hits, "hits")
    may = marked(spark.sparkContext.broadcast(row_filter(hits, "_one")))
    # The table's own columns travel as one, so that no name of theirs meets one of these.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_kept"), one.alias("_one"), two.alias("_two")).withColumn("_may", may(F.xxhash64("_one")))
    some = own.where("_may").join(hits, ["_one", "_two"], "left").select("_kept", F.coalesce("leaks", none).alias("leaks"))
    out = some.unionByName(own.where("not _may").select("_kept", none.alias("leaks")))
    return out.select(*(F.col(f"_kept.`{c}`").alias(c) for c in names), "leaks")


def _search(sent: list, names: list[str], text: str, leak: pa.DataType, only: bool = False):
    """What each text leaks, in the last column; with ``only``, without the text, and rows that leak something alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = lowered(batch.column(names.index(text)))
            for a, b in steps(offsets):
                both = [list(x or ()) for x in batch.column(len(names))[a:b].to_pylist()]
                for block in sent:
                    some, ends = sliced(data, offsets, a, b)
                    found = [long_leaks(block.value, some)] if len(ends) == 2 and ends[1] > arrays.LONG_BYTES else block.value.leaks(some, ends)
                    for mine, new in zip(both, found, strict=True):
                        mine += [dict(zip(("item_id", "cosine", "share", "start"), y, strict=True)) for y in new]
                columns = [*(c[a:b] for c in batch.columns[:-1]), pa.array(both, leak)]
                if only:
                    hit = np.flatnonzero([bool(x) for x in both])
                    yield pa.RecordBatch.from_arrays([columns[k].take(pa.array(hit)) for k in range(len(columns)) if k != names.index(text)], names=[*(c for c in names if c != text), "leaks"])
                else:
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "leaks"])

    return run
