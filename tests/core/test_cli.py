import random

import pytest
from pyspark.sql import functions as F

from polycat.__main__ import _parser, run
from polycat.schema import WEIGHTS


def call(spark, *words):
    return run(spark, _parser().parse_args([str(w) for w in words]))


@pytest.fixture
def shards(spark, tmp_path):
    r = random.Random(2)
    base = [(1, 1, 1, 1, 1, 1), (1, 1, 2, 2, 2, 4), (1, 1, 1, 1, 2, 2), (1, 1, 1, 1, 1, 6)]
    rows = [tuple(r.sample(r.choice(base), 6)) for _ in range(80)]
    (tmp_path / "in").mkdir()
    for k in range(4):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], ", ".join(f"{c} int" for c in WEIGHTS)).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        next((tmp_path / f"w{k}").glob("part-*.parquet")).rename(tmp_path / "in" / f"s{k}.parquet")
    return tmp_path, rows


def test_classify_resume_merge_and_enrich(spark, shards):
    path, rows = shards
    one = call(spark, "classify", "--input", path / "in", "--output", path / "all", "--non-reflexive")
    failed = sum(max(w) == 6 for w in rows)
    assert (one["files"], one["processed"], one["failed"], one["balanced"]) == (4, 80, failed, True)
    whole = sorted(map(str, spark.read.parquet(str(path / "all/catalogue")).collect()))
    assert len(whole) == 3
    # Some files, then the whole range again: nothing counts twice.
    call(spark, "classify", "--input", path / "in", "--output", path / "some", "--non-reflexive", "--start", 1, "--end", 2, "--spill-runs")
    two = call(spark, "classify", "--input", path / "in", "--output", path / "some", "--non-reflexive", "--resume")
    assert (two["files"], two["skipped"]) == (2, 2)
    assert sorted(map(str, spark.read.parquet(str(path / "some/catalogue")).collect())) == whole
    assert call(spark, "classify", "--input", path / "in", "--output", path / "some", "--non-reflexive", "--resume")["files"] == 0
    merged = call(spark, "merge", "--input", path / "some/runs", "--output", path / "merged", "--non-reflexive")
    assert merged == {"unique": 3} and sorted(map(str, spark.read.parquet(str(path / "merged")).collect())) == whole
    assert call(spark, "add-nf", "--input", path / "merged", "--output", path / "nf") == {"rows": 3, "failed": 0, "mismatches": 0}
    assert call(spark, "classify", "--input", path / "in", "--output", path / "b", "--benchmark", 5)["processed"] == 5
    assert call(spark, "concat", "--input", path / "in", "--output", path / "one") == {"rows": 80}


def counted(spark, path):
    return spark.read.parquet(str(path / "catalogue")).selectExpr("sum(count)").first()[0]


def test_a_fresh_start_forgets_what_was_there_and_nothing_counts_twice(spark, shards, monkeypatch):
    path, rows = shards
    good = lambda a, b: sum(max(w) != 6 for w in rows[20 * a : 20 * b])
    out = path / "o"
    base = ["classify", "--input", path / "in", "--output", out, "--non-reflexive"]
    call(spark, *base, "--start", 0, "--end", 1)
    assert counted(spark, out) == good(0, 2)
    call(spark, *base, "--start", 2, "--end", 3)
    assert counted(spark, out) == good(2, 4)
    got = call(spark, *base, "--start", 0, "--end", 3, "--resume")
    assert counted(spark, out) == good(0, 4) == got["counted_in_all"] and (got["files"], got["skipped"]) == (2, 2)
    # A crash after a run was written: its files are known, and are not done again.
    with monkeypatch.context() as m:
        m.setattr("polycat.sources.sinks.write_numbers", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            call(spark, *base, "--every", 3)
    assert call(spark, "progress", "--input", path / "in", "--output", out) == {"runs": {"run-00000-00002": 3}, "files_done": 3, "files": 4, "percent": 75, "catalogue": False}
    got = call(spark, *base, "--resume")
    assert (got["files"], got["skipped"]) == (1, 3) and counted(spark, out) == good(0, 4)
    summary = spark.read.json(str(out / "summary")).first()
    assert (summary.total_cws, summary.unique_polytopes, summary.files_processed, summary.backend) == (20, 3, 1, "auto")
    # Runs of other ranges stay where only runs are written; one range replaces itself, and none may overlap another.
    spill = ["classify", "--input", path / "in", "--output", path / "p", "--non-reflexive", "--spill-runs"]
    for _ in range(2):
        call(spark, *spill, "--start", 0, "--end", 1)
        call(spark, *spill, "--start", 2, "--end", 2)
    with pytest.raises(SystemExit, match="s1.parquet"):
        call(spark, *spill, "--start", 1, "--end", 3)
    assert spark.read.parquet(str(path / "p/runs")).selectExpr("sum(count)").first()[0] == good(0, 3)
    summary = spark.read.json(str(path / "p/summary")).first()
    assert (summary["mode"], summary.total_cws, summary.runs_written) == ("spill-runs", 20, 1)


def test_shards_merge_when_all_are_done_and_timing(spark, shards):
    path, rows = shards
    got = call(spark, "shards", "--input", path / "in", "--output", path / "s", "--shards", 3, "--non-reflexive")
    assert got == {"shards": 3, "unique": 3} and counted(spark, path / "s") == sum(max(w) != 6 for w in rows)
    assert call(spark, "progress", "--input", path / "in", "--output", path / "s")["runs"] == {"shard000-00000-00001": 2, "shard001-00002-00002": 1, "shard002-00003-00003": 1}
    for flags in (["--no-store"], ["--no-store", "--no-hash"]):
        got = call(spark, "classify", "--input", path / "in", "--output", path / "t", *flags)
        assert (got["processed"], got["failed"]) == (80, sum(max(w) == 6 for w in rows))
    assert not (path / "t").exists()


def test_generate_and_merge_computed(spark, tmp_path):
    assert call(spark, "generate", "--low", 6, "--high", 10, "--output", tmp_path / "g") == {"systems": 12}
    left = spark.createDataFrame([(0, k, k, 1) for k in range(4)], "source_row_group int, source_row_in_group int, count long, h11 int")
    right = spark.createDataFrame([(0, k, k * 2) for k in range(4)], "source_row_group int, source_row_in_group int, h11_c int")
    left.write.parquet(str(tmp_path / "l"))
    right.write.parquet(str(tmp_path / "r"))
    assert call(spark, "merge-computed", "--input", tmp_path / "l", "--computed", tmp_path / "r", "--output", tmp_path / "m")["aligned"]
    assert {(r.source_row_in_group, r.h11) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {(k, 2 * k) for k in range(4)}
    # The same positions in another order.
    right.orderBy(F.desc("source_row_in_group")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "r"))
    left.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "l"))
    assert call(spark, "merge-computed", "--input", tmp_path / "l", "--computed", tmp_path / "r", "--output", tmp_path / "m")["left_rows"] == 4
    assert {(r.source_row_in_group, r.h11) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {(k, 2 * k) for k in range(4)}
    right.limit(2).write.mode("overwrite").parquet(str(tmp_path / "r"))
    with pytest.raises(SystemExit):
        call(spark, "merge-computed", "--input", tmp_path / "l", "--computed", tmp_path / "r", "--output", tmp_path / "m2")


def test_a_run_that_was_being_replaced_is_old_or_new(spark, tmp_path, monkeypatch):
    from polycat.sources import sinks

    folder = f"file://{tmp_path}/runs"
    rows = lambda n: spark.createDataFrame([(f"k{j}", j) for j in range(n)], "nf_key string, count long")
    shown = lambda: spark.read.parquet(folder).count()
    sinks.write_run(rows(3), folder, "a", files=["x"])
    sinks.write_run(rows(5), folder, "a", files=["y"])
    assert shown() == 5 and sinks.run_files(spark, folder) == {"a": ["y"]}
    # Killed after the old run was put aside: it comes back.
    (tmp_path / "runs" / "run=a").rename(tmp_path / "runs" / ".a.aside")
    assert sinks.run_files(spark, folder) == {"a": ["y"]} and shown() == 5
    # Killed after the new one was there: the old one goes.
    sinks.write_run(rows(2), folder, "b")
    (tmp_path / "runs" / "run=b").rename(tmp_path / "runs" / ".a.aside")
    assert sinks.run_files(spark, folder) == {"a": ["y"]} and shown() == 5
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["run=a"]
    sinks.write_run(rows(4), folder, "a")
    assert shown() == 4
