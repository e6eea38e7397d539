from pathlib import Path

from polycat.operators import buckets
from polycat.operators.catalogue import merge


def run_of(spark, keys, at=0):
    return spark.createDataFrame([(f"k{k}", n, at + k, k % 7) for k, n in keys], "key string, count long, source_index long, extra int")


def shown(df):
    return sorted((r.key, r["count"], r.source_index, r.extra) for r in df.collect())


def files_of(folder):
    return {p.parent.name: p.name for p in Path(folder).rglob("*.parquet")}


def test_runs_add_up_and_only_touched_buckets_are_written(spark, tmp_path):
    folder = str(tmp_path / "c")
    runs = {"a": run_of(spark, [(k, 1 + k % 3) for k in range(400)]), "b": run_of(spark, [(k, 5) for k in range(300, 500)], -1000), "c": run_of(spark, [(7, 2), (1000, 1)])}
    for n, tag in enumerate(runs, 1):
        before = files_of(f"{folder}/catalogue") if n > 1 else {}
        made = buckets.add_run(runs[tag], folder, tag, key="key", buckets=32)
        after = files_of(f"{folder}/catalogue")
        assert shown(buckets.read(spark, folder)) == shown(merge(*list(runs.values())[:n], key=["key"]))
        assert made["touched"] == len([b for b in after if after[b] != before.get(b)])
    assert made == {"keys": 2, "touched": 2}
    # The same run again, and one of another content under its name.
    buckets.add_run(runs["b"], folder, "b", key="key", buckets=32)
    assert shown(buckets.read(spark, folder)) == shown(merge(*runs.values(), key=["key"]))
    assert buckets.add_run(runs["a"].where("false"), folder, "d", key="key", buckets=32) == {"keys": 0, "touched": 0}


def test_a_large_bucket_is_cut(spark, tmp_path):
    folder = str(tmp_path / "c")
    run = spark.range(20_000).selectExpr("md5(string(id)) as key", "1L as count", "id as source_index", "0L as extra")
    small = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    before = [spark.conf.get(c, None) for c in small]
    try:
        for c in small:
            spark.conf.set(c, "64k")
        buckets.add_run(run.repartition(4), folder, "a", key="key", buckets=1)
    finally:
        for c, v in zip(small, before, strict=True):
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert shown(buckets.read(spark, folder)) == shown(run)
    assert len(list(Path(f"{folder}/catalogue").rglob("*.parquet"))) > 1
