"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two generative models, bags of hashed words and word pairs, are counted: one over
all documents, one over the documents that are marked as targets.  A document's
log importance weight is the log ratio of its probabilities; adding Gumbel noise
and taking the k largest samples k documents without replacement in proportion
to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polycat.llm.arrays import LOWER, MARKS, Words, is_long, mix, sliced, steps, text_bytes, word_hashes
from polycat.llm.filters import passes, row_filter
from polycat.llm.shared import Workspace
from polycat.operators.sampling import ranked

BUCKETS_BITS = 14


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each word and word pair."""
    data = LOWER[data]
    words = Words(data, offsets, MARKS)
    h = words.hashes(data)
    same = words.doc[:-1] == words.doc[1:]
    pair = mix(h[:-1][same] * np.uint64(0x9E3779B97F4A7C15) + h[1:][same], 5)
    row = np.concatenate([words.doc, words.doc[:-1][same]])
    return row, (np.concatenate([h, pair]) >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)


def gram_steps(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same; of one long text in pieces, each with the pair that it begins with."""
    if not is_long(offsets):
        yield grams(data, offsets)
        return
    before = np.zeros(0, np.uint64)
    for h in word_hashes(data, MARKS):
        run = np.concatenate([before, h])
        pair = mix(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + run[1:], 5)
        bucket = (np.concatenate([h, pair]) >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)
        yield np.zeros(len(bucket), np.int64), bucket
        before = run[-1:]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BUCKETS_BITS, np.int64)
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for a, b in steps(offsets):
            for _, bucket in gram_steps(*sliced(data, offsets, a, b)):
                    total += np.bincount(bucket, minlength=len(total))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["bucket", "n"])


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts by bucket over all rows of a column of texts; the driver gets a row for each bucket."""
    got = texts.mapInArrow(_counts, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKETS_BITS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket, each with one count more than seen."""
    return np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())


def resample(docs: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", share: float = 0.5, seed: int = 0) -> DataFrame:
    """Which documents a sample of ``share`` of all rows takes, by importance weights.

    ``targets``: ids (``doc_id``) of the documents that the target model is counted
    on, all of them and whole.  Returns the id, ``log_weight``, ``gumbel_key`` (the weight
    plus noise from a hash of the id and ``seed``) and ``kept``: the round(share *
    rows) largest keys, and no more: of equal ones (repeats of one id and text)
    as many as are wanted.  A null or empty text has log weight 0.
    No rows give none.
    Without any target all weights are what the smoothing gives.  Other columns
    of ``docs`` are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "importance")
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("id"), F.xxhash64(doc_id).alias("h"), F.xxhash64(F.col(doc_id), F.lit(seed + 17)).alias("draw"), F.col(text).alias("text"))
    wanted = work.save(targets.select(F.col(doc_id).alias("id")).where("id is not null").distinct(), "targets")
    sent = spark.sparkContext.broadcast(row_filter(wanted))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that may be targets, so that only their texts are shuffled."""
        for batch in batches:
            hit = passes(sent.value, batch.column(1).to_numpy())
            yield batch.select(["id", "text"]).filter(pa.array(hit))

    chosen = source.select("id", "h", "text").mapInArrow(likely, f"id {kind}, text string").join(wanted, "id", "left_semi").select("text")
    ratio = spark.sparkContext.broadcast(log_ratio(gram_counts(chosen), gram_counts(source.select("text"))))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in steps(offsets):
                weight = sum(np.bincount(row, ratio.value[bucket], b - a) for row, bucket in gram_steps(*sliced(data, offsets, a, b)))
                u = (mix(batch.column(1)[a:b].to_numpy().astype(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5
                key = weight - np.log(-np.log(u / float(1 << 53)))
                bits = key.view(np.int64)
                rank = np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(weight), pa.array(key), pa.array(rank)], names=["id", "weight", "key", "rank"])

    scored = work.save(source.select("id", "draw", "text").mapInArrow(weigh, f"id {kind}, weight double, key double, rank bigint"), "scored")
    rows = scored.count()
    take = round(share * rows)
    least, wanted_of, equal = kth_with_ties(scored, take)
    keep = F.lit(False) if least is None else F.col("rank") >= least
    if wanted_of < equal:
        # Of those that tie for the last place: numbered over all partitions, as many as are wanted.
        tied = ranked(scored.where(F.col("rank") == least).withColumn("at", F.monotonically_increasing_id()), ["at"], name="place")
        tied = tied.select("id", "weight", "key", (F.col("place") < wanted_of).alias("kept"))
        others = scored.where(F.col("rank") != least).select("id", "weight", "key", (F.col("rank") > least).alias("kept"))
        out = others.unionByName(tied)
    else:
        out = scored.select("id", "weight", "key", keep.alias("kept"))
    return out.select(F.col("id").alias(doc_id), F.col("weight").alias("log_weight"), F.col("key").alias("gumbel_key"), "kept")


def kth_largest(scored: DataFrame, k: int) -> int | None:
    """The k-th largest ``rank``, exactly; None for k = 0."""
    return kth_with_ties(scored, k)[0]


def kth_with_ties(scored: DataFrame, k: int) -> tuple[int | None, int, int]:
    """The k-th largest ``rank``, exactly, by four counts over 16 bits each (None for k = 0); how many of its rows belong to the k largest, and how many there are."""
    if k <= 0:
        return None, 0, 0
    high, left, equal = None, k, 0
    for shift in (48, 32, 16, 0):
        some = scored if high is None else scored.where(F.shiftright("rank", shift + 16) == high)
        counts = some.groupBy(F.shiftright("rank", shift).alias("top")).count().collect()  # 65,536 rows at most
        for r in sorted(counts, key=lambda r: -r["top"]):
            if left <= r["count"]:
                high, equal = r["top"], r["count"]
                break
            left -= r["count"]
    return high, left, equal
