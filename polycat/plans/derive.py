"""Deterministic weight systems from integer keys, as DataFrame expressions and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polycat.functions.weights import reduced, total
from polycat.schema import METADATA, WEIGHTS
from polycat.sources.files import spread

#: Moduli of the six weights: 46 systems up to order, 2 of them without an interior origin.
FEW = (2, 3, 4, 5, 7, 5)
#: More than a thousand systems up to order.
MANY = (4, 5, 6, 7, 9, 11)


def weights_of(key: Column, moduli: tuple = MANY) -> Column:
    """w_i = 1 + key * (i + 3) mod m_i, over the common divisor."""
    return reduced(F.array(*((1 + (key.cast("bigint") * (k + 3)) % m).cast("bigint") for k, m in enumerate(moduli))))


def weights_sql(key: str, moduli: tuple = MANY) -> str:
    """The same as a SQL list."""
    raw = [f"(1 + ({key}) * {k + 3} % {m})" for k, m in enumerate(moduli)]
    g = raw[0]
    for x in raw[1:]:
        g = f"gcd({g}, {x})"
    return f"[{', '.join(f'({x} // {g})::BIGINT' for x in raw)}]"


def weight_rows(df: DataFrame, key: Column, moduli: tuple = MANY) -> DataFrame:
    """Resolved weight rows of a table: its key is the source index; metadata is 0."""
    keys = spread(df.select(key.cast("bigint").alias("source_index")))
    w = keys.select("source_index", weights_of(F.col("source_index"), moduli).alias("w"))
    return w.select(
        "source_index",
        F.lit(1).alias("nw"),
        F.lit(len(WEIGHTS)).alias("n"),
        F.array(total(F.col("w"))).alias("degrees"),
        F.array("w").alias("rows"),
        *(F.get("w", F.lit(k)).cast("int").alias(c) for k, c in enumerate(WEIGHTS)),
        F.lit(0).alias("structure_id"),
        F.lit(1).alias("profile_id"),
        *(F.lit(0).alias(c) for c in METADATA),
    )
