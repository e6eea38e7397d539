"""Catalogues of distinct polytopes: counting, a deterministic representative, merging, resuming, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polycat.functions.weights import canonical
from polycat.operators.classify import classify
from polycat.schema import REFLEXIVE_ONLY, WEIGHTS
from polycat.storage import Workspace

__all__ = ["REFLEXIVE_ONLY", "Workspace", "accounting", "catalogue", "classified", "count_first", "key_halves", "merge", "resume", "strict_union"]


def count_first(df: DataFrame, key: list[str], payload: list[str], *, index: str = "source_index", count: Column | None = None) -> DataFrame:
    """One row for each key: ``count``, the least ``index``, and the payload of the row that has it.

    Each payload column is an aggregate of its own on primitive values, so Spark
    counts in hash tables, partly before the shuffle; a key of any frequency
    costs each task one row.  Rows with one index are taken to be one row.
    """
    total = F.count("*") if count is None else F.sum(count)
    return df.groupBy(*key).agg(total.cast("bigint").alias("count"), F.min(index).alias(index), *(F.min_by(c, index).alias(c) for c in payload if c != index))


def catalogue(weights: DataFrame, *, reflexive: bool = False, presort: bool = True, remember: bool = True, backend: str = "auto", tasks: int | None = None) -> DataFrame:
    """The distinct polytopes of resolved weight rows, each with its count and first row.

    With ``presort`` rows whose weights differ only by order or a common factor are
    merged before the kernel runs: their polytopes are the same, and the kernel is
    nearly all of the cost.  Rows that the kernel rejects aren't in the catalogue.
    ``remember=False`` without ``presort`` runs the kernel on every row, repeats too.
    ``reflexive`` adds the dual's columns.
    """
    payload = [*WEIGHTS, *(REFLEXIVE_ONLY if reflexive else [])]
    tried = classified(weights, payload, presort=presort, remember=remember, backend=backend, tasks=tasks)
    return count_first(tried.where("ok"), ["nf_key"], [*payload, "vertex_count", "facet_count", "point_count"], count=F.col("count"))


def classified(weights: DataFrame, payload: list[str], *, presort: bool = True, remember: bool = True, backend: str = "auto", tasks: int | None = None) -> DataFrame:
    """Kernel results with ``count`` rows behind each: one for each distinct system, or for each row without ``presort``."""
    if not presort:
        return classify(weights.select("source_index", "rows", "degrees", *payload).withColumn("count", F.lit(1).cast("bigint")), backend=backend, tasks=tasks, remember=remember)
    first = F.element_at("rows", 1)
    simple = (F.size("rows") == 1) & F.forall(first, lambda x: x > 0) & ((F.element_at("degrees", 1) == 0) | (F.element_at("degrees", 1) == F.aggregate(first, F.lit(0).cast("bigint"), lambda a, x: a + x)))
    like = F.when(simple, F.array(canonical(first))).otherwise(F.col("rows"))
    keyed = weights.select("source_index", like.alias("rows"), F.when(simple, F.array(F.lit(0).cast("bigint"))).otherwise(F.col("degrees")).alias("degrees"), *payload)
    return classify(count_first(keyed, ["rows", "degrees"], payload), backend=backend, tasks=tasks)


def merge(*catalogues: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Catalogues as one: counts add up, the representative with the least index stays.

    Merging is associative and commutative, so shards may be merged in any order or
    at once.  Columns must be the same.
    """
    key = key or ["nf_key"]
    whole = strict_union(*catalogues)
    payload = [c for c in whole.columns if c not in {*key, "count", "source_index"}]
    return count_first(whole, key, payload, count=F.col("count")).select(*whole.columns)


def strict_union(*tables: DataFrame) -> DataFrame:
    """UNION ALL of tables whose columns and types are the same, in any order of columns; else an error."""
    first = tables[0]
    want = {f.name: f.dataType for f in first.schema.fields}
    out = first
    for other in tables[1:]:
        have = {f.name: f.dataType for f in other.schema.fields}
        if have != want:
            odd = sorted(n for n in {*have, *want} if have.get(n) != want.get(n))
            raise ValueError(f"schemas differ in {', '.join(odd)}")
        out = out.unionByName(other)
    return out


def resume(previous: DataFrame, ledger: DataFrame, rows: DataFrame, *, unit: str, key: list[str], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """A catalogue and its ledger of finished units (files) after some more rows.

    Rows of units that the ledger has are left out, so running a range again
    doesn't count it twice.  The ledger, a row for each file, goes to every task: dealt by
    unit, the rows of one large file would all be one task's.
    """
    fresh = rows.join(F.broadcast(ledger.select(unit).distinct()), unit, "left_anti")
    added = count_first(fresh, key, payload)
    return merge(previous, added.select(*previous.columns), key=key), ledger.select(unit).unionByName(fresh.select(unit).distinct())


def accounting(tried: DataFrame) -> DataFrame:
    """One row: processed, failed, distinct and duplicate rows, and whether processed = distinct + duplicate + failed.

    ``tried`` has ``ok``, ``nf_key`` and ``count``.
    """
    keys = tried.groupBy("ok", "nf_key").agg(F.sum("count").alias("n"))
    out = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("processed"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).cast("bigint").alias("failed"),
        F.count_if("ok").cast("bigint").alias("unique"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n") - 1)), F.lit(0)).cast("bigint").alias("duplicate"),
    )
    return out.withColumn("balanced", F.col("processed") == F.col("unique") + F.col("duplicate") + F.col("failed"))


def key_halves(key: Column) -> tuple[Column, Column]:
    """The high and low 64 bits of a key as unsigned decimals."""
    text = F.hex(key)
    return tuple(F.conv(F.substring(text, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))
