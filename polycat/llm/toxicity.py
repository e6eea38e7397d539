"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Each coordinate has its own learning rate and an L1 penalty keeps most weights
at zero, so the model is a short list of (feature, weight).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polycat.llm.arrays import LOWER, MARKS, Words, is_long, mix, sliced, steps, text_bytes, word_hashes
from polycat.llm.shared import Workspace

BITS = 20
SKIPS = (1, 2)  # pairs of neighbours, and of words with one between


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed features of all words and word pairs, with repeats."""
    if is_long(offsets):
        return _long_features(data)
    data = LOWER[data]
    words = Words(data, offsets, MARKS)
    h = words.hashes(data)
    row, feature = [words.doc], [h]
    for k, skip in enumerate(SKIPS, 1):
        if len(h) > skip:
            same = words.doc[:-skip] == words.doc[skip:]
            pair = mix(h[:-skip][same] * np.uint64(0x9E3779B97F4A7C15) + h[skip:][same], k)
            row.append(words.doc[:-skip][same]), feature.append(pair)
    return np.concatenate(row), (np.concatenate(feature) >> np.uint64(64 - BITS)).astype(np.int64)


def _long_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of one long text, a piece at a time."""
    seen, before = np.zeros(1 << BITS, bool), np.zeros(0, np.uint64)
    for h in word_hashes(data, MARKS):
        run = np.concatenate([before, h])
        found = [h, *(mix(run[:-skip] * np.uint64(0x9E3779B97F4A7C15) + run[skip:], k) for k, skip in enumerate(SKIPS, 1) if len(run) > skip)]
        for f in found:
            seen[(f >> np.uint64(64 - BITS)).astype(np.int64)] = True
        before = run[-max(SKIPS) :]
    feature = np.flatnonzero(seen)
    return np.zeros(len(feature), np.int64), feature


@dataclass
class Model:
    """Features with a weight that isn't zero, their weights, and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.feature] = self.weight
        return out


def fit(rows: list[np.ndarray], labels: np.ndarray, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.01, epochs: int = 6, seen: int = 3) -> Model:
    """FTRL-proximal over rows of distinct features, in the order given; features in fewer than ``seen`` rows are left out."""
    size = (1 << BITS) + 1  # the last is the bias, without a penalty
    z, n = np.zeros(size), np.zeros(size)
    penalty = np.full(size, l1)
    penalty[-1] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        short = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty[at], 0.0)
        return -short / ((beta + np.sqrt(n[at])) / alpha + l2)

    count = np.bincount(np.concatenate([np.zeros(0, np.int32), *rows]), minlength=1 << BITS)
    rows = [np.append(r[count[r] >= seen], size - 1) for r in rows]
    for _ in range(epochs):
        for at, y in zip(rows, labels.tolist(), strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            before = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - before) / alpha * w
    w = weights(np.arange(size))
    some = np.flatnonzero(w[:-1])
    return Model(some, w[some].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20000) -> Model:
    """A model from about ``sample`` of the rows of ``docs`` that ``labels`` marks 0 or 1, drawn by a hash of the key.

    The sample is learned in the order of that hash in one task, which returns the
    weights that aren't zero; null labels, keys and texts are not learned from.
    Without any row the model scores all texts 0.5.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    total = known.count()
    hashed = F.pmod(F.xxhash64("k", F.lit(2)), F.lit(1 << 20))
    known = known.where(hashed < min(1 << 20, -(-(sample << 20) // max(total, 1))))
    drawn = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text")).where(hashed < min(1 << 20, -(-(sample << 20) // max(total, 1))))
    # Rows that repeat are learned from once; a key of many texts is thinned by text, so that the sample's size has a bound.
    drawn = drawn.join(known, "k").select("k", "y", "text", F.xxhash64("k", "text", F.lit(3)).alias("h")).dropDuplicates(["k", "y", "h"])
    drawn = Workspace(docs.sparkSession, "toxicity").save(drawn.select("y", "text", "h"), "drawn")
    rows = drawn.count()
    if rows > sample + sample // 4:
        drawn = drawn.where(F.pmod(F.xxhash64("h", F.lit(4)), F.lit(1 << 20)) < -(-(sample << 20) // rows))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            y += batch.column(0).to_pylist()
            for a, b in steps(offsets):
                row, feature = features(*sliced(data, offsets, a, b))
                both = np.unique(row << BITS | feature)
                cut = np.searchsorted(both, np.arange(b - a + 1) << BITS)
                rows += [(both[u:v] & ((1 << BITS) - 1)).astype(np.int32) for u, v in zip(cut[:-1], cut[1:], strict=True)]
        m = fit(rows, np.array(y))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(m.feature, -1)), pa.array(np.append(m.weight, m.bias).astype(np.float64))], names=["feature", "weight"])

    got = drawn.repartition(1).sortWithinPartitions("h", "y", "text").mapInArrow(learn, "feature bigint, weight double").toArrow()
    feature, weight = got.column(0).to_numpy(), got.column(1).to_numpy()
    bias = float(weight[feature < 0].sum())
    return Model(feature[feature >= 0], weight[feature >= 0].astype(np.float32), bias)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability that a text is toxic; a null text is scored as an empty one.

    All rows stay, repeated ones too, and no rows give none; a column that is named ``score`` is replaced.
    """
    source = docs.drop("score")
    names = source.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value.table(), sent.value.bias
        for batch in batches:
            data, offsets = text_bytes(batch.column(names.index(text)))
            for a, b in steps(offsets):
                row, feature = features(*sliced(data, offsets, a, b))
                hit = table[feature] != 0
                both = np.unique(row[hit] << BITS | feature[hit])
                total = np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], b - a) + bias
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns), pa.array(p)], names=[*names, "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]
    return source.mapInArrow(run, ", ".join([*fields, "score double"]))
