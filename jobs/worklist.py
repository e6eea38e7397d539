"""What a run of the kernel has to do: the distinct weight systems, by what cheap numbers say of them.

``python -m jobs.worklist --source TABLE --target FOLDER [--config FILE] [--bands 3 4]``

Rows whose weights differ only by order or a common factor are one system, kept
once with its count and first row.  A system whose origin can't be interior needs no
kernel at all; of the others the local numbers (distinct weights, multiplicities,
ones, whether all weights divide the degree) say which are alone with theirs and which
share them and need comparing.  The result is written by ``status`` and by band of
degrees, so that a run can be given some of it; ``report`` counts it.  With ``--bands``
only those bands are made anew and all others stay as they are.
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
from polycat.operators import cascade as C
from polycat.operators.catalogue import count_first
from polycat.operators.metrics import counted
from polycat.plans.derive import weights_of
from polycat.schema import WEIGHTS
from polycat.storage import Scope, Workspace

log = logging.getLogger("jobs.worklist")

DEFAULT = Path(__file__).with_suffix(".json")
#: What a system is told by without the kernel.
LOCAL = ["n_distinct", "multiplicities", "n_ones", "gorenstein"]
COLUMNS = ["system", "count", "source_index", *WEIGHTS, "degree", *LOCAL, "sharing", "status", "band"]
SCHEMA = "system string, count bigint, source_index bigint, " + ", ".join(f"{c} int" for c in WEIGHTS) + ", degree bigint, n_distinct bigint, multiplicities string, n_ones bigint, gorenstein boolean, sharing bigint, status string, band bigint"


def systems(rows: DataFrame, config: dict) -> tuple[DataFrame, Callable[[], dict]]:
    """The distinct systems of a table, with count, first row and local numbers; and what gives the numbers of rows."""
    at = F.expr(config["index"]).cast("bigint").alias("source_index")
    if config.get("derive"):
        given = rows.select(at).withColumn("ws", weights_of(F.col("source_index")))
    else:
        given = rows.select(at, F.array(*(F.col(c).cast("bigint") for c in WEIGHTS)).alias("ws"))
    good = F.forall("ws", lambda x: F.coalesce(x > 0, F.lit(False)))
    tried, taken = counted(given.withColumn("_good", good), F.count("*").alias("rows"), F.count_if(~F.col("_good")).alias("rejected"))
    shown = tried.where("_good").select(W.shown(W.canonical(F.col("ws"))).alias("system"), "source_index", *(F.get("ws", F.lit(k)).cast("int").alias(c) for k, c in enumerate(WEIGHTS)))
    found = count_first(shown, ["system"], WEIGHTS).withColumn("ws", F.transform(F.split("system", " "), lambda x: x.cast("bigint")))
    w = F.col("ws")
    numbers = [W.distinct(w).alias("n_distinct"), W.shown(W.multiplicities(w)).alias("multiplicities"), W.ones(w).alias("n_ones"), W.gorenstein(w).alias("gorenstein")]
    found = found.select("system", "count", "source_index", *WEIGHTS, W.total(w).alias("degree"), *numbers, W.may_be_interior(w).alias("inside"))
    return found, taken


def worklist(spark: SparkSession, config: dict, source: str, target: str, *, bands: list[int] | None = None) -> dict:
    """Write the worklist of a table; returns the numbers of rows, rejected rows and systems.

    Weights are the table's columns, or derived from its index where the configuration says so; a row
    with a weight that is null or not positive is rejected.  Running it again gives
    the same files' rows.  ``bands``: only these are written; what they
    need of the others (who shares local numbers) is computed from the whole table.
    """
    target = target.rstrip("/")
    with Scope(spark):
        found, taken = systems(spark.read.parquet(source), config)
        found = Workspace(spark, "worklist").save(found, "found")
        numbers = taken()
        may = F.col("inside")
        sharing = C.with_group_sizes(found.where(may), LOCAL).withColumnRenamed("members", "sharing")
        closed = found.where(~may).withColumn("sharing", F.lit(0).cast("bigint"))
        status = F.when(~may, "no_interior").when(F.col("sharing") == 1, "alone").otherwise("shared")
        band = F.floor(F.col("degree") / config["band"]).cast("bigint")
        out = sharing.unionByName(closed).withColumn("status", status).withColumn("band", band).select(*COLUMNS)
        if bands is not None:
            out = out.where(F.col("band").isin(bands))
        # Rebalanced: a band of any size is cut into files of the advised size.
        writer = out.hint("rebalance", "status", "band").write.partitionBy("status", "band").mode("overwrite").option("compression", "zstd")
        (writer if bands is None else writer.option("partitionOverwriteMode", "dynamic")).parquet(f"{target}/systems")
    report = read(spark, target).groupBy("status").agg(F.count("*").alias("systems"), F.sum("count").alias("rows"))
    report.coalesce(1).write.mode("overwrite").json(f"{target}/report")
    numbers["systems"] = sum(r["systems"] for r in spark.read.schema(report.schema).json(f"{target}/report").collect())
    log.info("read %d rows of %s, %d rejected; wrote %s/systems, which has %d systems", numbers["rows"], source, numbers["rejected"], target, numbers["systems"])
    return numbers


def read(spark: SparkSession, target: str) -> DataFrame:
    """The worklist as it stands."""
    return spark.read.schema(SCHEMA).parquet(f"{target.rstrip('/')}/systems")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m jobs.worklist", description="What a run of the kernel has to do.")
    p.add_argument("--source", required=True, help="Parquet table with weights")
    p.add_argument("--target", required=True, help="folder of the result")
    p.add_argument("--config", default=str(DEFAULT), help="JSON file")
    p.add_argument("--bands", type=int, nargs="+", help="only these bands of degrees")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("worklist").getOrCreate()
    try:
        worklist(spark, json.loads(Path(args.config).read_text()), args.source, args.target, bands=args.bands)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
