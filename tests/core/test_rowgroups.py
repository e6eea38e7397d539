import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from polycat.operators import enrich
from polycat.sources import rowgroups


def tables(folder, sizes=(1000, 0, 350), left_group=64, right_group=100, shift=0):
    """Two folders of files with the same rows in the same order, row groups of other sizes."""
    out, at = ([], []), 0
    for k, n in enumerate(sizes):
        ids = np.arange(at, at + n)
        at += n
        place = {"source_row_group": pa.array(ids // 50, pa.int32()), "source_row_in_group": pa.array(ids % 50, pa.int32())}
        left = pa.table(place | {"count": pa.array(ids * 3), "h11": pa.array(ids % 7, pa.int32()), "name": pa.array([f"n{i}" for i in ids], pa.string()), "nf": pa.array([[int(i), 1] for i in ids], pa.list_(pa.int64()))})
        right = pa.table(place | {"h11_c": pa.array((ids + shift) % 11, pa.int32()), "h12_c": pa.array([None if i % 5 == 0 else int(i) for i in ids], pa.int64())})
        for side, table, group in ((0, left, left_group), (1, right, right_group)):
            path = f"{folder}/{'lr'[side]}{k}.parquet"
            pq.write_table(table, path, row_group_size=group)
            out[side].append(path)
    return out


def test_aligned_tables_side_by_side(spark, tmp_path):
    left, right = tables(tmp_path)
    given = {"rename": {"h11_c": "h11", "h12_c": "h12"}}
    got = enrich.aligned_merge(spark, left, right, rows=200, **given)
    want = enrich.positional_merge(*(spark.read.parquet(*side) for side in (left, right)), **given)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.rdd.getNumPartitions() == 6  # of four row groups each, the last of each file fewer
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert enrich.aligned_merge(spark, [f"file://{p}" for p in left], right, **given).count() == 1350


def test_tables_that_arent_aligned(spark, tmp_path):
    left, right = tables(tmp_path)
    with pytest.raises(Exception, match="aren't aligned"):
        enrich.aligned_merge(spark, left, right[:2]).collect()
    short = pq.read_table(right[2])
    pq.write_table(short.slice(1), right[2])
    with pytest.raises(Exception, match="has 350 rows"):
        enrich.aligned_merge(spark, left, right).collect()
    # As many rows, but two have changed places.
    order = list(range(350))
    order[200], order[201] = 201, 200
    pq.write_table(short.take(pa.array(order)), right[2])
    with pytest.raises(Exception, match="differ in source_row_in_group"):
        enrich.aligned_merge(spark, left, right).collect()


def test_rows_by_number(spark, tmp_path):
    left, _ = tables(tmp_path)
    wanted = [("l0.parquet", k) for k in (0, 63, 64, 999, 500, 500)] + [("l2.parquet", 349)]
    positions = spark.createDataFrame(wanted, "f string, r long")
    got = rowgroups.fetch(spark, left, positions, columns=["name", "nf"], file="f", row="r").collect()
    assert {(r.file_name, r.row_index): (r.name, list(r.nf)) for r in got} == {(f, k): (f"n{k + 1000 * (f == 'l2.parquet')}", [k + 1000 * (f == "l2.parquet"), 1]) for f, k in wanted}
    assert len(got) == len(set(wanted))
    everything = rowgroups.fetch(spark, left[:1], positions.where("f = 'l0.parquet'"), file="f", row="r")
    assert everything.columns == ["file_name", "row_index", *pq.read_schema(left[0]).names]
    assert everything.count() == 5 and rowgroups.fetch(spark, left, positions.where("false"), file="f", row="r").count() == 0
    for bad in [("l0.parquet", 1000), ("l0.parquet", -1), ("l1.parquet", 0), ("other.parquet", 0), ("l0.parquet", None)]:
        with pytest.raises(Exception, match="no row"):
            rowgroups.fetch(spark, left, spark.createDataFrame([bad], "file_name string, row_index long")).collect()


def test_only_row_groups_with_wanted_rows_are_read(spark, tmp_path):
    """All other row groups are overwritten with nonsense: reading any of them would fail."""
    left, _ = tables(tmp_path, sizes=(1000,))
    meta = pq.read_metadata(left[0])
    data = bytearray(open(left[0], "rb").read())
    keep, touched = {3, 9}, 0
    for k in range(meta.num_row_groups):
        group = meta.row_group(k)
        for c in range(group.num_columns):
            column = group.column(c)
            begin = column.dictionary_page_offset or column.data_page_offset
            if k in keep:
                touched += column.total_compressed_size
            else:
                data[begin : begin + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    open(left[0], "wb").write(data)
    positions = spark.createDataFrame([("l0.parquet", 3 * 64 + 5), ("l0.parquet", 9 * 64)], "file_name string, row_index long")
    got = rowgroups.fetch(spark, left, positions, columns=["name"]).collect()
    assert sorted(r.name for r in got) == ["n197", "n576"]
    assert touched < 0.2 * len(data)
    with pytest.raises(Exception):
        spark.read.parquet(left[0]).where(F.col("name") == "n197").collect()
