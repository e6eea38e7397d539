"""Cheap keys first: an expensive key is computed only for rows that cheap keys leave undecided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polycat.storage import Workspace


def group_sizes(df: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys and their row counts."""
    return df.groupBy(*key).agg(F.count("*").cast("bigint").alias("members"))


def _joined(df: DataFrame, groups: DataFrame, key: list[str], how: str) -> DataFrame:
    """A join on key columns in which nulls are equal, as they are when rows are grouped."""
    named = groups.select(*(F.col(c).alias(f"_key{k}") for k, c in enumerate(key)), *(c for c in groups.columns if c not in key))
    on = F.lit(True)
    for k, c in enumerate(key):
        on = on & df[c].eqNullSafe(named[f"_key{k}"])
    return df.join(named, on, how).drop(*(f"_key{k}" for k in range(len(key))))


def _written(groups: DataFrame) -> DataFrame:
    """Groups that are joined back to the rows they were counted from: written first, so that Spark can split a hot one's rows."""
    return Workspace(groups.sparkSession, "cascade").save(groups, "groups")


def collisions(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key some other row has too; nulls are equal."""
    return _joined(df, _written(group_sizes(df, key).where("members > 1").select(*key)), key, "left_semi")


def with_group_sizes(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` with ``members``, the number of rows of the row's group; nulls are equal."""
    return _joined(df, _written(group_sizes(df, key)), key, "inner")


def cascade(df: DataFrame, free: list[str], expensive: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """The rows that neither the free columns nor the expensive key tell apart, with ``members`` of their group.

    ``expensive`` adds the column ``key`` and is only applied to rows that collide on
    the free columns.
    """
    left = expensive(collisions(df, free))
    left = _written(left)  # what was expensive is done once
    return _joined(left, _written(group_sizes(left, [*free, key]).where("members > 1")), [*free, key], "inner")


def cascade_report(df: DataFrame, free: list[str], expensive: Callable[[DataFrame], DataFrame], key: str, *, flag: str | None = None) -> DataFrame:
    """One row: rows, free groups, colliding rows, and distinct (free, expensive) keys over all rows.

    Rows that don't collide have a key of their own, so the last number needs the
    expensive key of the colliding ones alone.  ``flag``: a boolean column that
    ``expensive`` adds; ``unflagged`` counts the tested rows where it is false.
    """
    sizes = group_sizes(df, free).select("members", F.lit(0).cast("bigint").alias("keys"), F.lit(0).cast("bigint").alias("off"))
    tested = expensive(collisions(df, free))
    off = F.count_if(~F.col(flag)) if flag else F.lit(0)
    keys = tested.groupBy(*free, key).agg(off.cast("bigint").alias("off")).select(F.lit(0).cast("bigint").alias("members"), F.lit(1).cast("bigint").alias("keys"), "off")
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    out = sizes.unionByName(keys).agg(some("members").alias("n_rows"), F.count_if(F.col("members") > 0).cast("bigint").alias("free_groups"), some(F.when(F.col("members") > 1, F.col("members"))).alias("colliding"), some("keys").alias("keys_in_collisions"), some("off").alias("unflagged"))
    out = out.withColumn("distinct_keys", F.col("n_rows") - F.col("colliding") + F.col("keys_in_collisions"))
    return out if flag else out.drop("unflagged")


def histogram(df: DataFrame, stratum: Column, name: str = "stratum") -> DataFrame:
    return df.groupBy(stratum.cast("bigint").alias(name)).agg(F.count("*").cast("bigint").alias("n"))


def verdicts(df: DataFrame, group: list[str], deep: str) -> DataFrame:
    """For each group of two rows or more: members, distinct deep keys, and whether those tell all members apart."""
    each = df.groupBy(*group, deep).agg(F.count("*").alias("n"))
    out = each.groupBy(*group).agg(F.sum("n").cast("bigint").alias("members"), F.count("*").cast("bigint").alias("keys")).where("members > 1")
    return out.withColumn("verdict", F.when(F.col("keys") == F.col("members"), "RESOLVED").otherwise("STILL COLLIDING"))


def pairs_within(df: DataFrame, group: list[str], index: str, columns: list[str]) -> DataFrame:
    """Unordered pairs of rows of a group, as ``_a`` and ``_b`` columns; for the small groups that a cascade leaves."""
    df = _written(df)
    a = df.select(*group, *(F.col(c).alias(f"{c}_a") for c in [index, *columns]))
    b = df.select(*group, *(F.col(c).alias(f"{c}_b") for c in [index, *columns]))
    return _joined(a, b, group, "inner").where(F.col(f"{index}_a") < F.col(f"{index}_b"))


def classes_within(df: DataFrame, group: list[str], index: str, columns: list[str], tested: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For each row the class that it belongs to within its group: ``group``, ``index``, ``class_id`` and ``links``.

    ``tested`` adds a boolean ``same`` to pairs of rows (``index`` and ``columns`` as ``_a`` and
    ``_b``); it must be an equivalence.  In rounds, each group's row of the least index
    that has no class yet stands for a class, and all others without one are tested against
    it.  So there are as many tests as rows times classes, at most, never all pairs; a
    round has one row of each group on one side, and rows of a hot group are tested in
    all tasks.  ``class_id`` is the least index of the class, ``links`` how many other rows it
    has, and ``undecided`` how many tests of the row gave null, which counts as not the same.  Indexes must be
    unique in their group; there are as many rounds as the group with the most classes has.  A table without rows has no classes.
    """
    work = Workspace(df.sparkSession, "classes")
    open_ = work.save(df.select(*group, index, *columns).withColumn("_undecided", F.lit(0)), "round0")
    done, n = [], 0
    while open_.limit(1).count():
        n += 1
        # The columns of the first row travel as they are: one row of each group.
        first = open_.groupBy(*group).agg(F.min_by(F.struct(index, *columns), index).alias("_first"))
        first = work.save(first, f"first{n}")
        named = first.select(*(F.col(c).alias(f"_key{k}") for k, c in enumerate(group)), *(F.col(f"_first.{c}").alias(f"{c}_a") for c in [index, *columns]))
        on = F.lit(True)
        for k, c in enumerate(group):
            on = on & open_[c].eqNullSafe(named[f"_key{k}"])
        pairs = open_.join(named, on).select(*group, f"{index}_a", *(f"{c}_a" for c in columns), *(F.col(c).alias(f"{c}_b") for c in [index, *columns]), "_undecided")
        own = F.col(f"{index}_a") == F.col(f"{index}_b")
        kept = [*group, F.col(f"{index}_a").alias("class_id"), F.col(f"{index}_b").alias(index), *(F.col(f"{c}_b").alias(c) for c in columns)]
        mine = pairs.where(own).select(*kept, "_undecided", F.lit(True).alias("_same"))
        found = tested(pairs.where(~own)).select(*kept, F.col("_undecided") + F.col("same").isNull().cast("int"), F.coalesce("same", F.lit(False)).alias("_same"))
        tried = work.save(mine.union(found), f"tried{n}")
        work.drop(f"round{n - 1}")
        work.drop(f"first{n}")
        done.append(tried.where("_same").select(*group, index, "class_id", F.col("_undecided").alias("undecided")))
        open_ = work.save(tried.where("not _same").select(*group, index, *columns, "_undecided"), f"round{n}")
    if not done:
        return open_.select(*group, index, F.col(index).alias("class_id"), F.lit(0).alias("undecided"), F.lit(0).cast("bigint").alias("links"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    key = [*group, "class_id"]
    sizes = _written(out.groupBy(*key).agg((F.count("*") - 1).alias("links")))
    return _joined(out, sizes, key, "inner").select(*group, index, "class_id", "undecided", "links")


def identical_members(df: DataFrame, group: list[str], blob: str, canonical: str) -> DataFrame:
    """For each group: whether all blobs are the same, and whether all canonical values are."""
    out = df.groupBy(*group).agg(F.count("*").cast("bigint").alias("members"), F.min(blob).alias("_a"), F.max(blob).alias("_b"), F.min(canonical).alias("_c"), F.max(canonical).alias("_d"))
    return out.select(*group, "members", F.col("_a").eqNullSafe(F.col("_b")).alias("same_bytes"), F.col("_c").eqNullSafe(F.col("_d")).alias("same_points"))


def pair_verdicts(pairs: DataFrame, group: list[str]) -> DataFrame:
    """For each group of tested pairs: how many of each verdict, and what follows for the group.

    DISTINCT: all pairs are inequivalent.  DUPLICATES: some pair is equivalent.  OPEN:
    neither, since some pair couldn't be decided.
    """
    of = lambda v: F.count_if(F.col("verdict") == v).cast("bigint")
    out = pairs.groupBy(*group).agg(F.count("*").cast("bigint").alias("pairs"), of("EQUIVALENT").alias("equivalent"), of("INEQUIVALENT").alias("inequivalent"))
    verdict = F.when(F.col("equivalent") > 0, "DUPLICATES").when(F.col("inequivalent") == F.col("pairs"), "DISTINCT").otherwise("OPEN")
    return out.withColumn("verdict", verdict)


def fibre_mass(df: DataFrame, count: str, stratum: str) -> DataFrame:
    """Per stratum: polytopes, the rows behind them, the largest count, singletons, and the running total of rows."""
    from pyspark.sql.window import Window

    out = df.groupBy(stratum).agg(
        F.count("*").cast("bigint").alias("fibres"),
        F.sum(count).cast("bigint").alias("n_rows"),
        F.max(count).cast("bigint").alias("largest"),
        F.count_if(F.col(count) == 1).cast("bigint").alias("singletons"),
    )
    # A row for each stratum, so one task is enough.
    return out.withColumn("rows_up_to", F.sum("n_rows").over(Window.orderBy(stratum)).cast("bigint"))
