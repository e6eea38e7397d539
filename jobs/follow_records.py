"""Follow a folder of records and keep a catalogue of the distinct ones, with counts and first places.

``python -m jobs.follow_records --source FOLDER --target FOLDER --checkpoint FOLDER [--config FILE]``

Every call takes the files that came since the last one and ends; the stream's
checkpoint knows which they are.  What a record is says the configuration:

* ``lines``: each line of a text, without white space at its ends; key: its MD5,
* ``weights``: a weight system; key: its weights, sorted and over their common divisor,
* ``polytopes``: a weight system; key: that of the polytope's normal form, by the kernel.

A call with new files adds a run for each batch and makes the buckets anew that
the run touches (``polycat.operators.buckets``).  A batch that is run again after a
crash replaces its own run, so records are counted once.
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polycat.functions import weights as W
from polycat.operators import buckets
from polycat.operators.catalogue import catalogue, count_first
from polycat.operators.metrics import counted
from polycat.plans.derive import weights_of
from polycat.schema import WEIGHTS, resolve_input

log = logging.getLogger("jobs.follow_records")

#: The configuration beside this file.
DEFAULT = Path(__file__).with_suffix(".json")
#: The name of the key, the partial catalogue, and what gives the numbers of records.
Records = tuple[str, DataFrame, Callable[[], dict]]
SPACE = r"[\x20\x09-\x0D]+"


def _systems(rows: DataFrame, config: dict) -> DataFrame:
    """(source_index, weights): of the columns, or derived from the index where the configuration says so."""
    at = F.expr(config["index"]).cast("bigint").alias("source_index")
    if config.get("derive"):
        return rows.select(at).select("source_index", *(F.get(weights_of(F.col("source_index")), F.lit(k)).cast("int").alias(c) for k, c in enumerate(WEIGHTS)))
    return rows.select(at, *WEIGHTS)


def _checked(rows: DataFrame, config: dict) -> tuple[DataFrame, Callable[[], dict]]:
    """The systems, with ``_good`` where all six weights are positive."""
    good = F.lit(True)
    for c in WEIGHTS:
        good = good & F.coalesce(F.col(c) > 0, F.lit(False))
    return counted(_systems(rows, config).withColumn("_good", good), F.count("*").alias("records"), F.count_if(~F.col("_good")).alias("rejected"))


def _lines(rows: DataFrame, config: dict) -> Records:
    lines = rows.select(F.expr(config["index"]).cast("bigint").alias("source_index"), F.explode(F.split(F.col(config["text"]), "\n")).alias("line"))
    bare, taken = counted(lines.select("source_index", F.regexp_replace("line", f"^{SPACE}|{SPACE}$", "").alias("line")), F.count("*").alias("records"), F.count_if(F.col("line") == "").alias("rejected"))
    keyed = bare.where("line <> ''").select(F.md5("line").alias("key"), F.length("line").cast("bigint").alias("chars"), "source_index")
    return "key", count_first(keyed, ["key", "chars"], []), taken


def _weights(rows: DataFrame, config: dict) -> Records:
    systems, taken = _checked(rows, config)
    key = W.shown(W.canonical(F.array(*(F.col(c).cast("bigint") for c in WEIGHTS))))
    return "key", count_first(systems.where("_good").select("source_index", key.alias("key"), *WEIGHTS), ["key"], WEIGHTS), taken


def _polytopes(rows: DataFrame, config: dict) -> Records:
    systems, taken = _checked(rows, config)
    return "nf_key", catalogue(resolve_input(systems.where("_good").drop("_good"))), taken


KINDS = {"lines": _lines, "weights": _weights, "polytopes": _polytopes}


def _pattern(source: str) -> str:
    """A pattern that only this path fits: streams take a single file by pattern alone."""
    source = source.rstrip("/")
    return source if set("*?[{") & set(source) else f"{source[:-1]}[{source[-1]}]"


def follow(spark: SparkSession, config: dict, source: str, target: str, checkpoint: str) -> dict:
    """Add what is new in ``source`` to the catalogue in ``target``; returns the numbers of batches, records and so on of this call.

    ``source`` is a folder of Parquet files (or one file) of one schema (of the configuration's
    ``schema``, or of the files that are there).  A null text has no lines, an empty line is
    rejected, and so is a weight that is null or not positive.  ``polytopes`` leaves
    out systems that the kernel rejects.  Without new files nothing is written.
    """
    records = KINDS[config["kind"]]
    target = target.rstrip("/")
    done = {"batches": 0, "records": 0, "rejected": 0, "keys": 0, "touched": 0}

    def add(batch: DataFrame, number: int) -> None:
        key, run, taken = records(batch, config)
        made = buckets.add_run(run, target, f"{number:09d}", key=key, buckets=config["buckets"])
        numbers = taken() | made | {"batches": 1}
        for name in done:
            done[name] += numbers[name]
        log.info("batch %d of %s: %d records read, %d rejected; wrote %d keys and %d of %d buckets of %s", number, source, numbers["records"], numbers["rejected"], made["keys"], made["touched"], config["buckets"], target)

    schema = config.get("schema") or spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.get("files_per_batch", 100)).parquet(_pattern(source))
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %s", source, json.dumps(done))
    return done


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m jobs.follow_records", description="A catalogue of distinct records that follows a folder.")
    p.add_argument("--source", required=True, help="folder of Parquet files")
    p.add_argument("--target", required=True, help="folder of runs and catalogue")
    p.add_argument("--checkpoint", required=True, help="folder of the stream's checkpoint")
    p.add_argument("--config", default=str(DEFAULT), help="JSON file")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("follow_records").getOrCreate()
    try:
        follow(spark, json.loads(Path(args.config).read_text()), args.source, args.target, args.checkpoint)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
