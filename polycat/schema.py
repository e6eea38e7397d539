"""Input and output schemas of the engine, told apart by the columns that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, MOST_ROWS, MOST_COORDINATES = 6, 5, 10
WEIGHTS = [f"weight{k}" for k in range(WIDTH)]
METADATA = ["vertex_count", "facet_count", "point_count", "dual_point_count", "h11", "h12", "h13"]
COMBINED_MARKERS = ["nw", "N", "degree0", "weight0_0"]
CATALOGUE = ["nf_key", "count", "source_index", *WEIGHTS, "vertex_count", "facet_count", "point_count"]
REFLEXIVE_ONLY = ["dual_point_count", "h11", "h12", "h13"]


def _or_zero(df: DataFrame, name: str) -> Column:
    return (F.coalesce(F.col(name).cast("int"), F.lit(0)) if name in df.columns else F.lit(0)).alias(name)


def profile_of_structure(structure: Column) -> Column:
    """The profile of a structure id.

    Fixed values: the last structure id of each of the profiles 1 to 7; 0 beyond.
    """
    last = {1: 1, 2: 3, 3: 7, 4: 14, 5: 32, 6: 45, 7: 47}
    out = F.lit(0)
    for profile, top in reversed(last.items()):
        out = F.when(structure <= top, profile).otherwise(out)
    return out


def is_combined(df: DataFrame) -> bool:
    return all(c in df.columns for c in COMBINED_MARKERS)


def resolve_input(df: DataFrame, *, index: str | None = None) -> DataFrame:
    """Weight rows of either input schema in one form, with nothing read that isn't needed.

    Returns source_index, nw, n, degrees (array), rows (array of arrays), the six
    weights (zero for combined systems of more coordinates), structure_id,
    profile_id and the metadata columns; columns that the input lacks are 0.
    ``index`` names the column that orders rows where the input has no
    ``source_index``.  A combined row whose numbers don't fit raises an error.
    """
    if is_combined(df):
        structure = F.coalesce(F.col("structure_id"), F.lit(0)) if "structure_id" in df.columns else F.lit(0)
        profile = F.coalesce(F.col("profile_id"), profile_of_structure(structure)) if "profile_id" in df.columns else profile_of_structure(structure)
        good = F.col("nw").between(1, MOST_ROWS) & F.col("N").between(1, MOST_COORDINATES) & (F.col("N") - F.col("nw") == 5)
        nw = F.when(good, F.col("nw")).otherwise(F.raise_error(F.concat(F.lit("bad combined weight system: nw="), F.coalesce(F.col("nw").cast("string"), F.lit("null")), F.lit(", N="), F.coalesce(F.col("N").cast("string"), F.lit("null"))))).cast("int")
        cell = lambda r, c: F.coalesce(F.col(f"weight{r}_{c}").cast("bigint"), F.lit(0)) if f"weight{r}_{c}" in df.columns else F.lit(0).cast("bigint")
        rows = F.slice(F.array(*(F.slice(F.array(*(cell(r, c) for c in range(MOST_COORDINATES))), F.lit(1), F.col("N")) for r in range(MOST_ROWS))), F.lit(1), nw)
        degrees = F.slice(F.array(*(F.col(f"degree{r}").cast("bigint") if f"degree{r}" in df.columns else F.lit(0).cast("bigint") for r in range(MOST_ROWS))), F.lit(1), nw)
        single = [F.when(F.col("nw") == 1, cell(0, k)).otherwise(0).cast("int").alias(c) for k, c in enumerate(WEIGHTS)]
        source = F.col("source_index") if "source_index" in df.columns else F.col(index)
        return df.select(source.cast("bigint").alias("source_index"), nw.alias("nw"), F.col("N").cast("int").alias("n"), degrees.alias("degrees"), rows.alias("rows"), *single, structure.cast("int").alias("structure_id"), profile.cast("int").alias("profile_id"), *(_or_zero(df, c) for c in METADATA))
    missing = [c for c in WEIGHTS if c not in df.columns]
    if missing:
        raise ValueError(f"not a weight table: {', '.join(missing)} missing")
    w = [F.col(c).cast("bigint") for c in WEIGHTS]
    degree = w[0]
    for x in w[1:]:
        degree = degree + x
    source = F.col("source_index") if "source_index" in df.columns else F.col(index)
    return df.select(
        source.cast("bigint").alias("source_index"),
        F.lit(1).alias("nw"),
        F.lit(WIDTH).alias("n"),
        F.array(degree).alias("degrees"),
        F.array(F.array(*w)).alias("rows"),
        *(F.col(c).cast("int").alias(c) for c in WEIGHTS),
        F.lit(0).alias("structure_id"),
        F.lit(1).alias("profile_id"),
        *(_or_zero(df, c) for c in METADATA),
    )


def resolve_catalogue(df: DataFrame) -> Column:
    """The weight rows that a catalogue row is recomputed from: the stored matrix, or its weights, or its first weights."""
    if all(c in df.columns for c in ("first_nw", "first_N", "first_weight0_0")):
        cell = lambda r, c: F.col(f"first_weight{r}_{c}").cast("bigint") if f"first_weight{r}_{c}" in df.columns else F.lit(0).cast("bigint")
        return F.slice(F.array(*(F.slice(F.array(*(cell(r, c) for c in range(MOST_COORDINATES))), F.lit(1), F.col("first_N")) for r in range(MOST_ROWS))), F.lit(1), F.col("first_nw"))
    for prefix in ("weight", "first_weight"):
        names = [f"{prefix}{k}" for k in range(WIDTH)]
        if all(c in df.columns for c in names):
            return F.array(F.array(*(F.col(c).cast("bigint") for c in names)))
    raise ValueError("the table has no weights to recompute from")
