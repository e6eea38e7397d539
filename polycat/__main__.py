"""The command line: ``python -m polycat COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polycat.operators import catalogue as K
from polycat.operators import enrich, generate
from polycat.operators.classify import classify as timed
from polycat.operators.metrics import counted
from polycat.schema import WEIGHTS
from polycat.sources import files, sinks
from polycat.storage import Scope


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="polycat", description="Catalogues of lattice polytopes from weight systems.")
    sub = p.add_subparsers(dest="command", required=True)

    c = sub.add_parser("classify", help="weight shards to a catalogue, or to a sorted run with --spill-runs")
    c.add_argument("--input", required=True, help="folder of Parquet shards")
    c.add_argument("--output", required=True)
    c.add_argument("--start", type=int, default=0, help="first file, by name")
    c.add_argument("--end", type=int, help="last file, included")
    c.add_argument("--max-rows", type=int, help="rows of each file")
    c.add_argument("--benchmark", type=int, metavar="N", help="only the first N rows of the first file")
    c.add_argument("--non-reflexive", action="store_true", help="leave out the dual's columns")
    c.add_argument("--no-presort", action="store_true", help="run the kernel on every row")
    c.add_argument("--backend", default="auto", help="kernel")
    c.add_argument("--spill-runs", action="store_true", help="write partial catalogues under OUTPUT/runs and no catalogue; those of other ranges stay")
    c.add_argument("--run-tag", default="run")
    c.add_argument("--every", type=int, metavar="N", help="a run for each N files, so that a crash costs N files at most")
    c.add_argument("--resume", action="store_true", help="skip files that runs under OUTPUT/runs are of, and add to these runs")
    c.add_argument("--no-store", action="store_true", help="only time kernel and hash: nothing is counted or written")
    c.add_argument("--no-hash", action="store_true", help="with --no-store: only time the kernel")

    s = sub.add_parser("shards", help="classify a folder in shards, one after the other, and merge them only if all of them succeeded")
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--shards", type=int, required=True)
    s.add_argument("--non-reflexive", action="store_true")

    r = sub.add_parser("progress", help="how many files of a folder the runs under OUTPUT/runs are of")
    r.add_argument("--input", required=True)
    r.add_argument("--output", required=True)

    m = sub.add_parser("merge", help="partial catalogues to one")
    m.add_argument("--input", required=True, nargs="+", help="folders of runs or catalogues")
    m.add_argument("--output", required=True)
    m.add_argument("--non-reflexive", action="store_true")

    n = sub.add_parser("add-nf", help="add normal forms to a catalogue")
    n.add_argument("--input", required=True)
    n.add_argument("--output", required=True)
    n.add_argument("--no-verify", action="store_true")

    j = sub.add_parser("merge-computed", help="put computed columns beside a catalogue, by position")
    j.add_argument("--input", required=True)
    j.add_argument("--computed", required=True)
    j.add_argument("--output", required=True)
    # The columns that a merge replaces, and what their successors are called.
    j.add_argument("--drop", nargs="*", default=["hash_lo", "hash_hi", "h11", "h12", "h13"])
    j.add_argument("--rename", nargs="*", default=["h11_c=h11", "h12_c=h12", "h13_c=h13"])

    t = sub.add_parser("concat", help="Parquet files of one schema to one file, in the order of their names")
    t.add_argument("--input", required=True)
    t.add_argument("--output", required=True)

    g = sub.add_parser("generate", help="candidate weight systems of a range of degrees")
    g.add_argument("--low", type=int, required=True)
    g.add_argument("--high", type=int, required=True)
    g.add_argument("--output", required=True)
    return p


def _tried(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    return K.classified(rows, _payload(a), presort=not a.no_presort, backend=a.backend)


def _payload(a: argparse.Namespace) -> list[str]:
    return [*WEIGHTS, *([] if a.non_reflexive else K.REFLEXIVE_ONLY)]


def _run(spark: SparkSession, tried: DataFrame, a: argparse.Namespace, runs: str, tag: str, part: list[str]) -> dict:
    """Write a run, and count what it is of while the kernel's results pass: one job, nothing kept beside the run.

    The run itself says how many rows it has behind it; where tasks that ran twice counted some
    twice, that shows, and the numbers are taken anew.
    """
    count, ok = F.col("count"), F.col("ok")
    sums = (F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("processed"), F.coalesce(F.sum(F.when(~ok, count)), F.lit(0)).cast("bigint").alias("failed"))
    seen, taken = counted(tried, *sums)
    path = sinks.write_run(K.count_first(seen.where("ok"), ["nf_key"], [*_payload(a), "vertex_count", "facet_count", "point_count"], count=count), runs, tag, files=part)
    wrote = spark.read.parquet(path).agg(F.count("*").alias("unique"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
    numbers = taken()
    if numbers["processed"] - numbers["failed"] != wrote.rows:
        numbers = tried.agg(*sums).first().asDict()
    out = {"processed": numbers["processed"], "failed": numbers["failed"], "unique": wrote.unique, "duplicate": wrote.rows - wrote.unique}
    return out | {"balanced": out["processed"] == out["unique"] + out["duplicate"] + out["failed"]}


def classify(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Runs over a range of files, each with the names of its files; then their merged catalogue, and a summary.

    Without ``--resume`` and ``--spill-runs`` this is a fresh start: whatever was under
    OUTPUT goes first.  Files that other runs are of are never counted twice: with
    ``--resume`` they are skipped, else they are an error.
    """
    began = time.perf_counter()
    if a.benchmark is not None:
        a.start, a.end, a.max_rows = 0, 0, a.benchmark
    every = [f.rsplit("/", 1)[-1] for f in files.list_files(spark, a.input)]
    chosen = files.file_range(every, a.start, a.end)
    if a.no_store:
        rows = files.read_weights(spark, a.input, start=a.start, end=a.end, max_rows=a.max_rows)
        tried = timed(rows.select("source_index", "rows", "degrees"), backend=a.backend, hashed=not a.no_hash)
        numbers = tried.agg(F.count("*").alias("processed"), F.count_if(~F.col("ok")).alias("failed"), F.bit_xor(F.xxhash64("nf_key", "nf")).alias("sink")).first().asDict()
        return {"files": len(chosen), **numbers, "seconds": time.perf_counter() - began}
    runs = f"{a.output}/runs"
    if not a.resume and not a.spill_runs:
        for name in ("runs", "metrics", "catalogue", "summary"):
            store, at = files.hadoop(spark, f"{a.output}/{name}")
            store.delete(at, True)
    known = sinks.run_files(spark, runs)
    done = {f for some in known.values() for f in some} if a.resume else set()
    todo = [f for f in chosen if f not in done]
    parts = [todo[k : k + (a.every or len(todo))] for k in range(0, len(todo), a.every or len(todo) or 1)]
    tags = [f"{a.run_tag}-{every.index(p[0]):05d}-{every.index(p[-1]):05d}" for p in parts]
    twice = sorted({f for tag, some in known.items() if tag not in tags for f in some} & set(todo))
    if twice:
        raise SystemExit(f"other runs under {runs} are of {', '.join(twice[:5])} too; use --resume to skip such files")
    total: dict = {}
    for tag, part in zip(tags, parts, strict=True):
        with Scope(spark):
            rows = files.read_weights(spark, a.input, start=a.start, end=a.end, max_rows=a.max_rows, only=part)
            numbers = _run(spark, _tried(rows, a), a, runs, tag, part)
            sinks.write_numbers(spark, numbers, f"{a.output}/metrics/{tag}")
            for name, n in numbers.items():
                total[name] = n if isinstance(n, bool) else total.get(name, 0) + n
    report = dict(total)
    if a.spill_runs:
        seconds = time.perf_counter() - began
        sinks.write_summary(spark, f"{a.output}/summary", total, seconds=seconds, files=len(todo), backend=a.backend, runs=len(parts))
    elif known or parts:
        sinks.write_catalogue(K.merge(spark.read.parquet(runs).drop("run")), f"{a.output}/catalogue", reflexive=not a.non_reflexive)
        unique = spark.read.parquet(f"{a.output}/catalogue").agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
        report |= {"unique_in_all": unique.n, "counted_in_all": unique.rows}
        whole = total | {"unique": unique.n, "duplicate": unique.rows - unique.n}
        sinks.write_summary(spark, f"{a.output}/summary", whole, seconds=time.perf_counter() - began, files=len(todo), backend=a.backend)
    return {"files": len(todo), "skipped": len(chosen) - len(todo), **report}


def shards(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Runs of contiguous shards, then one merge; a shard that fails leaves no catalogue, and its run can be made again."""
    ranges = files.shard_ranges(len(files.list_files(spark, a.input)), a.shards)
    same = ["--input", a.input, "--output", a.output, *(["--non-reflexive"] if a.non_reflexive else [])]
    for k, (start, end) in enumerate(ranges):
        classify(spark, _parser().parse_args(["classify", *same, "--start", str(start), "--end", str(end), "--spill-runs", "--resume", "--run-tag", f"shard{k:03d}"]))
    sinks.write_catalogue(K.merge(spark.read.parquet(f"{a.output}/runs").drop("run")), f"{a.output}/catalogue", reflexive=not a.non_reflexive)
    return {"shards": len(ranges), "unique": spark.read.parquet(f"{a.output}/catalogue").count()}


def progress(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Files done, by run and in all, and whether there is a catalogue."""
    names = {f.rsplit("/", 1)[-1] for f in files.list_files(spark, a.input)}
    known = sinks.run_files(spark, f"{a.output}/runs")
    done = {f for some in known.values() for f in some} & names
    store, at = files.hadoop(spark, f"{a.output}/catalogue/_SUCCESS")
    return {"runs": {tag: len(some) for tag, some in sorted(known.items())}, "files_done": len(done), "files": len(names), "percent": 100 * len(done) // len(names), "catalogue": store.exists(at)}


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Do what the command line says and return what is worth reporting."""
    if a.command == "classify":
        return classify(spark, a)
    if a.command == "shards":
        return shards(spark, a)
    if a.command == "progress":
        return progress(spark, a)
    if a.command == "merge":
        parts = [spark.read.parquet(x) for x in a.input]
        sinks.write_catalogue(K.merge(*(p.drop("run") for p in parts)), a.output, reflexive=not a.non_reflexive)
        return {"unique": spark.read.parquet(a.output).count()}
    if a.command == "add-nf":
        out = enrich.add_normal_forms(spark.read.parquet(a.input), verify=not a.no_verify)
        out.write.mode("overwrite").option("compression", "zstd").parquet(a.output)
        back = spark.read.parquet(a.output)
        return back.agg(F.count("*").alias("rows"), F.count_if(F.col("nf_vertices").isNull()).alias("failed"), (F.count_if(~F.col("key_matches")) if "key_matches" in back.columns else F.lit(None)).alias("mismatches")).first().asDict()
    if a.command == "merge-computed":
        given = {"drop": tuple(a.drop), "rename": dict(x.split("=") for x in a.rename)}
        sides = [files.list_files(spark, x) for x in (a.input, a.computed)]
        if enrich.same_rows(*sides):
            # Row by row, where the files have the rows in the same order; positions are compared as they are read.
            try:
                enrich.aligned_merge(spark, *sides, **given).write.mode("overwrite").option("compression", "zstd").parquet(a.output)
                return {"rows": spark.read.parquet(a.output).count(), "aligned": True}
            except Exception as e:  # the same positions in another order: joined below
                if "differ in" not in str(e):
                    raise
        left, right = spark.read.parquet(a.input), spark.read.parquet(a.computed)
        audit = enrich.positional_audit(left, right).first().asDict()
        if not audit["aligned"]:
            raise SystemExit(f"the tables don't match by position: {audit}")
        enrich.positional_merge(left, right, **given).write.mode("overwrite").option("compression", "zstd").parquet(a.output)
        return audit
    if a.command == "concat":
        sinks.concatenate([spark.read.parquet(f) for f in files.list_files(spark, a.input)], a.output)
        return {"rows": spark.read.parquet(a.output).count()}
    found = generate.candidates(spark, a.low, a.high)
    found.select(*(F.get("weights", F.lit(k)).cast("int").alias(c) for k, c in enumerate(WEIGHTS))).write.mode("overwrite").parquet(a.output)
    return {"systems": spark.read.parquet(a.output).count()}


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("polycat").getOrCreate()
    print(json.dumps(run(spark, a), default=str))


if __name__ == "__main__":
    main()
