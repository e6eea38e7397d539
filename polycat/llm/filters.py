"""A Bloom filter of rows: it keeps texts that aren't needed out of shuffles.  An exact join follows it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each row, and at least and at most in all (128 KB and 16 MB); with more rows than fit more texts pass, and none gets lost.
BITS_A_ROW, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27


def bit_filter(hashes: DataFrame, rows: int) -> np.ndarray:
    """The filter of two 64-bit hashes of each row (columns ``a`` and ``b``) as 64-bit words; executors join its parts."""
    bits = min(max(1 << (BITS_A_ROW * rows).bit_length(), LEAST_BITS), MOST_BITS)
    each = hashes.select(F.explode(F.array(*(F.col(c).bitwiseAND(bits - 1) for c in ("a", "b")))).alias("bit"))
    words = each.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set"))
    out = np.zeros(bits // 64, np.uint64)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("set").to_numpy().view(np.uint64)
    return out


def row_filter(ids: DataFrame, column: str = "id") -> np.ndarray:
    """The filter of the ids' xxhash64 in its low and high half."""
    h = F.xxhash64(column)
    return bit_filter(ids.select(h.alias("a"), F.shiftright(h, 32).alias("b")), ids.count())


def passes(words: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Which rows may be in the filter, by their two hashes (or the halves of one); none that is gets lost."""
    hit = np.ones(len(a), bool)
    for bit in (x & (64 * len(words) - 1) for x in (a, a >> 32 if b is None else b)):
        hit &= (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
    return hit


def marked(sent):
    """Whether hashes are in a filter; only the hashes go to Python."""

    @F.pandas_udf("boolean")
    def may(hashes: pd.Series) -> pd.Series:
        return pd.Series(passes(sent.value, hashes.to_numpy()))

    return may
