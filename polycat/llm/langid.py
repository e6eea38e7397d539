"""Language identification by error-correcting output codes.

Each language gets a codeword.  For each bit a binary logistic classifier over
hashed byte n-grams says which side a text is on; decoding weighs each bit's
loss and chooses the codeword with the least.  A text is flagged as ambiguous
where the runner-up is close.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polycat.llm.arrays import LONG_BYTES, LOWER, STEP_BYTES, is_long, sliced, steps, text_bytes

ORDERS = (2, 3, 4)
ROWS = 512

#: Lower case, and one mark for every ASCII byte that isn't a letter.
FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def features(data: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams: a row of unit length for each text (0 for an empty one)."""
    if is_long(offsets):
        # Counts of pieces that begin with the bytes before them, less what those have alone.
        back, total = max(ORDERS) - 1, np.zeros((1, dims), np.float64)
        for a in range(0, len(data), LONG_BYTES):
            for begin, end, sign in ((max(a - back, 0), a + LONG_BYTES, 1), (max(a - back, 0), a, -1)):
                piece = data[begin:end]
                total += sign * _gram_counts(piece, np.array([0, len(piece)]), dims)
        out = total.astype(np.float32)
    else:
        out = _gram_counts(data, offsets, dims)
    total = out.sum(1, keepdims=True)
    np.divide(out, total, out=out, where=total > 0)
    return np.sqrt(out, out=out)


def _gram_counts(data: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, dims), np.float32)
    if not len(data):
        return out
    folded = FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    shift = np.uint32(32 - int(math.log2(dims)))
    gram = folded + np.uint32(1)
    for k in range(1, max(ORDERS)):
        gram = gram[:-1] * np.uint32(0x01000193) + folded[k:] + np.uint32(1)
        if k + 1 in ORDERS:
            whole = row[: len(gram)] == row[k:]
            bucket = (gram * np.uint32(0x9E3779B1)) >> shift
            at = row[: len(gram)][whole] * dims + bucket[whole]
            out += np.bincount(at, minlength=n * dims).reshape(n, dims)
    return out


def codewords(languages: int) -> np.ndarray:
    """A codeword of +-1 for each language: all splits for up to 5 languages, else 10 log2(n) bits, the best of some random draws."""
    if languages <= 5:
        splits = range(1, 1 << max(0, languages - 1))
        return np.array([[1 if k == 0 or not s >> (k - 1) & 1 else -1 for s in splits] for k in range(languages)], np.int8).reshape(languages, len(splits))
    draw, best, least = np.random.default_rng(5), None, -1
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), (languages, math.ceil(10 * math.log2(languages))))
        wide = code.astype(np.float32)
        apart = (code.shape[1] - wide @ wide.T) / 2
        np.fill_diagonal(apart, code.shape[1])
        if apart.min() > least and (np.abs(code.sum(0)) < languages).all():
            best, least = code, apart.min()
    return best


@dataclass
class Model:
    """Languages, their codewords, the bits' classifiers and how far each bit is trusted."""

    languages: list
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.weights)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language with the least weighted loss for each row, and each language's probability."""
        margins = x @ self.weights + self.bias
        # log(1 + exp(-m c)) is log(1 + exp(-m)) + m (1 - c) / 2 for c = +-1.
        loss = (self.trust * (np.logaddexp(0, -margins) + margins / 2)).sum(1)[:, None] - (self.trust * margins / 2) @ self.code.T.astype(np.float32)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        return loss.argmin(1), p


def fit(x: np.ndarray, labels: np.ndarray, languages: list, *, rounds: int = 300, rate: float = 30.0, decay: float = 1e-5) -> Model:
    """Logistic regression of all bits at once, by accelerated gradient steps over the whole sample."""
    code = codewords(len(languages))
    y = code[labels].astype(np.float32)
    share = np.bincount(labels, minlength=len(languages))
    weight = (1 / np.maximum(share, 1))[labels].astype(np.float32)[:, None]
    weight /= max(float(weight.sum()), 1e-9)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(rounds):
        pull = weight * y / (1 + np.exp(np.clip(y * (x @ ahead_w + ahead_b), -60, 60)))
        new_w = ahead_w + rate * (x.T @ pull - decay * ahead_w)
        new_b = ahead_b + rate / 8 * pull.sum(0)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new_w + (t - 1) / after * (new_w - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new_w, new_b, after
    right = (weight * ((x @ w + b) * y > 0)).sum(0) if len(y) else np.ones(code.shape[1])
    trust = np.maximum(2 * right - 1, 0.05)
    return Model(languages, code, w, b, (trust / max(float(trust.max(initial=0.0)), 1e-9)).astype(np.float32))


def train(docs: DataFrame, *, language: str = "lang", text: str = "text", key: str = "doc_id", each: int = 500, dims: int = 4096) -> Model:
    """A model from at most ``each`` labelled rows of every language of ``docs``, or all that it has.

    Rows are drawn by a hash of ``key`` and text, the least first, so the same rows give the same model.  The
    driver holds a row of ``dims`` numbers for each.  Rows with a null language or text are
    not learned from; without any row the model has no language.
    """
    rows = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text), F.lit(1)).alias("h"))
    counts = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())
    languages = [name for name, _ in counts]
    if not languages:
        return Model([], codewords(0), np.zeros((dims, 0), np.float32), np.zeros(0), np.zeros(0))
    share = pa.table({"lang": pa.array(languages, pa.string()), "share": pa.array([min(1 << 20, math.ceil((1 << 20) * (each + 5 * each**0.5) / n)) for _, n in counts], pa.int64())})
    some = rows.join(F.broadcast(docs.sparkSession.createDataFrame(share)), "lang")
    drawn = some.where(F.pmod("h", F.lit(1 << 20)) < F.col("share")).select("lang", "text", "h", F.pmod("h", F.lit(1 << 20)).alias("at"))
    # Rows that repeat are drawn together: the limit is kept by each partition before rows are shuffled.
    first = F.row_number().over(Window.partitionBy("lang").orderBy("at", "h"))
    drawn = drawn.withColumn("n", first).where(F.col("n") <= each).select("lang", "text", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in steps(offsets, rows=ROWS):
                x = features(*sliced(data, offsets, a, b), dims).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "h", "x"])

    got = drawn.mapInArrow(run, "lang string, h bigint, x binary").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    packed = got.column("x").combine_chunks()
    packed = packed if isinstance(packed, pa.Array) else packed.chunk(0)
    _, offsets, raw = packed.buffers()
    first, last = (np.frombuffer(offsets, np.int32)[packed.offset + k] for k in (0, len(packed))) if len(packed) else (0, 0)
    x = np.frombuffer(raw, np.uint8)[first:last].view(np.float16).reshape(-1, dims).astype(np.float32) if len(packed) else np.zeros((0, dims), np.float32)
    at = {name: k for k, name in enumerate(languages)}
    return fit(x, np.array([at[name] for name in got.column("lang").to_pylist()], np.int64), languages)


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    if is_long(offsets):
        read = codecs.getincrementaldecoder("utf-8")("replace")
        return np.array([any(any(map(str.isalpha, read.decode(data[a : a + STEP_BYTES].tobytes()))) for a in range(0, len(data), STEP_BYTES))])
    ascii_letter = (LOWER[data] >= 0x61) & (LOWER[data] <= 0x7A)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~out).tolist():
        out[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return out


def identify(docs: DataFrame, model: Model, *, text: str = "text", close: float = 0.5, sure: float = 0.0) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``; columns of these names are replaced.

    ``lang_pred`` is ``und`` with score 0 for a null text, one without a letter, and
    where the model has no language.  ``ambiguous``: the runner-up's probability is
    at least ``close`` times that of the best, or the text is ``und``.  All rows stay,
    repeated ones too; no rows give none.
    """
    results = ("lang_pred", "score", "ambiguous")
    source = docs.drop(*results)
    names = source.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)  # dims x bits, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(names.index(text)))
            for a, b in steps(offsets, rows=ROWS):
                d, o = sliced(data, offsets, a, b)
                lettered = _lettered(d, o) & bool(m.languages)
                pred, score, vague = ["und"] * (b - a), np.zeros(b - a), np.ones(b - a, bool)
                if m.languages:
                    best, p = m.decode(features(d, o, m.dims))
                    score = np.where(lettered, p.max(1), 0.0)
                    second = np.partition(p, -2, 1)[:, -2] if p.shape[1] > 1 else np.zeros(b - a)
                    vague = ~lettered | (second >= close * p.max(1))
                    pred = [m.languages[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns), pa.array(pred, pa.string()), pa.array(score.astype(np.float64)), pa.array(vague)], names=[*names, *results])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]
    return source.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, ambiguous boolean"]))


def rejected(least: float = 0.4) -> Column:
    """Rows whose language can't be told: no letter, or a score below ``least``."""
    return (F.col("lang_pred") == "und") | (F.col("score") < least)
