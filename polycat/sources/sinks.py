"""Writers: catalogues, sorted runs, metrics, golden records, one-file concatenation."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polycat.operators.catalogue import accounting, strict_union
from polycat.schema import CATALOGUE, REFLEXIVE_ONLY
from polycat.sources.files import hadoop

#: What a run's folder calls the list of its files; Spark doesn't read names that begin so.
RUN_FILES = "_files.json"
#: How the name of a run ends that is put aside.
ASIDE = ".aside"


def write_catalogue(catalogue: DataFrame, path: str, *, reflexive: bool = False, key: str = "nf_key") -> None:
    """A catalogue as ZSTD Parquet, ordered by key over all files; 13 columns' worth of it, or 17 with the dual's.

    Keys order as unsigned bytes.  Row groups are bounded by bytes, as Parquet's writer has it.
    """
    columns = [*CATALOGUE, *(REFLEXIVE_ONLY if reflexive else [])]
    catalogue.select(*columns).orderBy(key).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_run(catalogue: DataFrame, folder: str, tag: str, *, files: list[str] | None = None, key: str = "nf_key") -> str:
    """A sorted run in a folder of its own, with the names of the files that it is of; writing the same run again replaces it.

    Rows and file names are written beside the runs and become a run by one rename, so
    there is never a run whose files aren't known.  An older run of that name is put
    aside until then, and comes back where a write ended in between: there is the old run or the new one.
    """
    spark = catalogue.sparkSession
    folder = folder.rstrip("/")
    recover_runs(spark, folder)
    path, hidden = f"{folder}/run={tag}", f"{folder}/.{tag}-{uuid.uuid4().hex}"
    catalogue.sortWithinPartitions(key).write.option("compression", "zstd").parquet(hidden)
    store, at = hadoop(spark, path)
    out = store.create(hadoop(spark, f"{hidden}/{RUN_FILES}")[1], True)
    out.write(bytearray(json.dumps(files or []), "utf-8"))
    out.close()
    aside = hadoop(spark, f"{folder}/.{tag}{ASIDE}")[1]
    if store.exists(at) and not store.rename(at, aside):
        raise OSError(f"{path} couldn't be put aside")
    if not store.rename(hadoop(spark, hidden)[1], at):
        raise OSError(f"{path} couldn't be written")
    store.delete(aside, True)
    return path


def recover_runs(spark: SparkSession, folder: str) -> None:
    """Bring back runs that were put aside for new ones that never came, and delete those that were replaced."""
    store, at = hadoop(spark, folder)
    for status in store.listStatus(at) if store.exists(at) else []:
        name = status.getPath().getName()
        if name.endswith(ASIDE):
            run = hadoop(spark, f"{folder.rstrip('/')}/run={name[1:].removesuffix(ASIDE)}")[1]
            if store.exists(run):
                store.delete(status.getPath(), True)
            else:
                store.rename(status.getPath(), run)


def run_files(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The files that each run of a folder is of; without the folder none."""
    recover_runs(spark, folder)
    store, at = hadoop(spark, folder)
    if not store.exists(at):
        return {}
    out = {}
    for status in store.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("run="):
            stream = store.open(hadoop(spark, f"{folder.rstrip('/')}/{name}/{RUN_FILES}")[1])
            out[name.removeprefix("run=")] = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
    return out


def write_shards(df: DataFrame, folder: str, shard: str, number: int, *order: str, options: dict | None = None) -> list[str]:
    """The rows of each value 0, 1, ... of ``shard`` as one Parquet file, in order; files are named after the value.  ``options``: the writer's."""
    spark = df.sparkSession
    out = []
    for k in range(number):
        mine = df.where(F.col(shard) == k).drop(shard).repartition(1).sortWithinPartitions(*order)
        mine.write.mode("overwrite").option("compression", "zstd").options(**(options or {})).parquet(f"{folder}/.{k}")
        store, at = hadoop(spark, f"{folder}/.{k}")
        part = next(s.getPath() for s in store.listStatus(at) if s.getPath().getName().startswith("part-"))
        out.append(f"{folder}/shard-{k:05d}.parquet")
        store.rename(part, hadoop(spark, out[-1])[1])
        store.delete(at, True)
    return out


def write_residual(left: DataFrame, report: DataFrame, folder: str, *, row_id: str = "row_id", stratum: Column | None = None) -> None:
    """What a cascade leaves: the ids of the rows as Parquet, the report (one row) and counts by stratum as JSON."""
    left.select(row_id).orderBy(row_id).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/rows")
    if stratum is not None:
        # A row for each stratum; they and the report's one row are put together by one aggregate.
        by = left.groupBy(stratum.cast("string").alias("k")).agg(F.count("*").alias("n")).select(F.struct("k", "n").alias("by"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in report.schema.fields))
        both = report.select(F.lit(None).cast("struct<k:string,n:bigint>").alias("by"), *report.columns).unionByName(by)
        report = both.agg(*(F.max(c).alias(c) for c in report.columns), F.map_from_entries(F.array_sort(F.collect_list("by"))).alias("residual_by_stratum"))
    report.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def write_metrics(tried: DataFrame, path: str) -> None:
    """The accounting of a run as a JSON record."""
    accounting(tried).coalesce(1).write.mode("overwrite").json(path)


def write_numbers(spark: SparkSession, numbers: dict, path: str) -> None:
    """The accounting of a run, where it is known, as the same JSON record."""
    spark.createDataFrame([tuple(numbers.values())], ", ".join(f"{n} {'boolean' if isinstance(v, bool) else 'bigint'}" for n, v in numbers.items())).coalesce(1).write.mode("overwrite").json(path)


def write_summary(spark: SparkSession, path: str, numbers: dict, *, seconds: float, files: int, backend: str, runs: int | None = None) -> dict:
    """The summary of a classification as a JSON record: one shape for a catalogue, another where only runs were written.

    Fixed values: the names of the fields.
    """
    threads = spark.sparkContext.defaultParallelism
    total, failed = int(numbers.get("processed") or 0), int(numbers.get("failed") or 0)
    time = {"total_seconds": seconds, "throughput_cws_per_sec": total / seconds if seconds > 0 else 0.0, "files_processed": files, "threads": threads}
    if runs is None:
        record = {"total_cws": total, "failed_cws": failed, "duplicate_cws": int(numbers.get("duplicate") or 0), "unique_polytopes": int(numbers.get("unique") or 0), **time, "backend": backend}
    else:
        record = {"mode": "spill-runs", "total_cws": total, "failed_cws": failed, "runs_written": runs, **time}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return record


def write_golden(records: DataFrame, path: str) -> None:
    """Golden records as JSON lines."""
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.mode("overwrite").text(path)


def concatenate(tables: list[DataFrame], path: str) -> None:
    """Tables of one schema one after the other in one file, rows in their order (one task writes it all, as asked)."""
    parts = [t.withColumn("_table", F.lit(k)).withColumn("_row", F.monotonically_increasing_id()) for k, t in enumerate(tables)]
    whole = strict_union(*parts).repartition(1).sortWithinPartitions("_table", "_row").drop("_table", "_row")
    whole.write.mode("overwrite").option("compression", "zstd").parquet(path)
