import time
from itertools import product

import pytest

from polycat.operators import points
from polycat.sources import files, rowgroups, text


def blocks_of(spark, folder):
    got = text.normal_form_blocks(spark, f"file://{folder}").collect()
    return sorted((r.file.rsplit("/", 1)[-1], r.line, r.height, r.width, [list(x) for x in r.nf]) for r in got)


def test_a_file_of_blocks_is_read_by_many_tasks(spark, tmp_path):
    want = []
    for name in ("a.txt", "b.txt"):
        lines = ["some text before", "1 2 3", ""]
        for k in range(60):
            height, width = 2 + k % 4, 3 + k % 5
            rows = [[(k + i * j) % 17 - 8 for j in range(width)] for i in range(height)]
            want.append((name, len(lines), height, width, rows))
            lines += [f"{height} {width}  Normal form of vertices and more", *("  ".join(map(str, r)) for r in rows), *["beyond the block 1 2"] * (k % 3)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    assert blocks_of(spark, tmp_path) == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("97", "300"):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
            assert blocks_of(spark, tmp_path) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "b.txt").write_text("2 3 Normal form of vertices\n1 2 3\n1 2\n")
    with pytest.raises(Exception, match="short or uneven"):
        blocks_of(spark, tmp_path)
    (tmp_path / "b.txt").write_text("")
    assert len(blocks_of(spark, tmp_path)) == 60


def test_files_that_arent_whole_are_named_and_the_others_read(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    spark.range(100).selectExpr("id", "id % 3 as shard").repartition(3, "shard").write.parquet(folder)
    names = files.list_files(spark, folder)
    whole = open(names[0].removeprefix("file://"), "rb").read()
    bad = {"cut.parquet": whole[: len(whole) // 2], "tail.parquet": b"PAR1" + b"\xff" * 6 + b"\x7fPAR1", "empty-footer.parquet": b"PAR1" + b"\x00" * 20 + b"\x10\x00\x00\x00PAR1"}
    for name, data in bad.items():
        (tmp_path / "in" / name).write_bytes(data)
    good, wrong = files.sound_files(spark, folder)
    assert good == names and {f.rsplit("/", 1)[-1] for f, _ in wrong} == bad.keys()
    assert {f.rsplit("/", 1)[-1]: p for f, p in wrong if "Error" not in p and "Arrow" not in p and "OSError" not in p}.items() <= {"cut.parquet": "no trailer", "tail.parquet": "short footer"}.items()
    assert spark.read.parquet(*good).count() == 100
    missing = rowgroups.check_files(spark, [f"{folder}/none.parquet"]).first()
    assert missing.problem.startswith("FileNotFoundError") and missing.rows is None


def test_counts_of_points(spark):
    def brute(w):
        return sum(sum(a * b for a, b in zip(w, x, strict=True)) == sum(w) for x in product(*(range(sum(w) // v + 1) for v in w)))

    for w in [(1, 1), (1, 2, 3), (2, 3, 5), (1, 1, 1, 3, 4), (4, 5, 7, 2)]:
        assert points.solutions(list(w)) == brute(w)
    assert points.solutions([1] * 6) == 462
    began = time.perf_counter()
    large = points.solutions([1, 1, 1, 1, 2480, 2490])
    assert time.perf_counter() - began < 0.05
    assert large == sum((4974 - 2480 * a - 2490 * b + 3) * (4974 - 2480 * a - 2490 * b + 2) * (4974 - 2480 * a - 2490 * b + 1) // 6 for a in range(3) for b in range(3) if 2480 * a + 2490 * b <= 4974)
    # Beyond 64-bit sums, exactly.
    assert points.solutions([1] * 6 + [10**4]) == points.solutions([10**4] + [1] * 6) > 2**63 // 10**6
    rows = [(1, [1, 1, 1, 1, 1, 1], 5), (2, [2, 1, 3], 6), (3, None, 7), (4, [], 8), (5, [0, 1], 9), (6, [None, 1], 1), (7, [3, 2, 1], 2)]
    df = spark.createDataFrame(rows, "id long, w array<bigint>, _points int")
    got = points.with_point_count(df, "w").collect()
    assert got[0].asDict().keys() == {"id", "w", "_points", "points"}
    assert {r.id: r.points for r in got} == {1: 462, 2: 7, 3: None, 4: None, 5: None, 6: None, 7: 7}
