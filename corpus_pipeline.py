"""A corpus pipeline of five operators: documents in, a mixed and cleaned corpus out.

``STAGES`` lists (name, function); each function takes the session, the documents
that the stage before it kept, and the folder of the tables.  ``run`` applies them
to ``documents``, each result written as Parquet to the shared folder and read
again, so that a lost executor never costs more than a stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polycat.llm import langid, leaks, lines, minhash, mixing
from polycat.storage import Scope, Workspace, tidy


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (see ``langid.rejected``); the others go.

    The model learns from rows of the same documents that it judges: a filter, not a measure of accuracy.
    """
    model = langid.train(docs)
    return langid.identify(docs, model).where(~langid.rejected()).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that other documents keep; ``n_chars`` follows the text."""
    kept = lines.apply_bitmaps(docs, lines.shared_lines(docs))
    n_chars = F.when(F.col("_n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80, bands=32, rows=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks.find_leaks(docs, benchmark).where(F.size("leaks") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mixture of sources."""
    return mixing.mix(docs)


def _tidied(stage):
    """A stage that begins with what the one before it left on the driver cleared away."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, _tidied(f)) for f in (language_id, line_dedup, near_dedup, decontaminate, mix_sources)]

#: A trained classifier and latent retrieval aren't SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with Scope(spark):  # what the stage needs on its way
            docs = work.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
