import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polycat import schema
from polycat.functions import weights as W
from polycat.kernel.canonical import normal_form, normal_form_bytes
from polycat.operators import cascade, catalogue, classify, enrich, generate, sampling
from polycat.plans.derive import FEW, MANY, weight_rows
from polycat.sources import files, sinks, text
from polycat.streaming import incremental
from tests.core.bases import moved

V1 = ", ".join(f"weight{k} int" for k in range(6))


@pytest.fixture(scope="module")
def systems():
    r = random.Random(1)
    base = [(1, 1, 1, 1, 1, 1), (1, 1, 2, 2, 2, 4), (1, 1, 1, 3, 4, 4), (1, 1, 1, 1, 2, 2), (1, 1, 1, 1, 1, 6), (2, 2, 2, 2, 4, 4)]
    return [tuple(r.sample(r.choice(base), 6)) for _ in range(120)]


def resolved(spark, rows):
    df = spark.createDataFrame([(k, *w) for k, w in enumerate(rows)], f"source_index long, {V1}")
    return schema.resolve_input(df)


def as_rows(df):
    return sorted(map(str, df.collect()))


def test_catalogue_counts_and_first_rows(spark, systems):
    rows = resolved(spark, systems)
    out = {tuple(sorted(np.array([r[c] for c in schema.WEIGHTS]) // np.gcd.reduce([r[c] for c in schema.WEIGHTS]))): r for r in catalogue.catalogue(rows).collect()}
    like = lambda w: tuple(sorted(np.array(w) // np.gcd.reduce(w)))
    good = [w for w in systems if max(w) * 2 <= sum(w)]
    assert set(out) == {like(w) for w in good}
    for key, r in out.items():
        mine = [k for k, w in enumerate(systems) if like(w) == key]
        assert (r["count"], r.source_index) == (len(mine), min(mine))
        assert tuple(r[c] for c in schema.WEIGHTS) == systems[min(mine)]
        p, points = classify.polytope_of([list(key)])
        assert bytes(r.nf_key) == classify.nf_key([int(x) for x in normal_form(p).ravel()])
        assert (r.vertex_count, r.facet_count, r.point_count) == (len(p.vertices), len(p.normals), points)


def test_any_split_and_order_of_work_gives_one_catalogue(spark, systems):
    rows = resolved(spark, systems).cache()
    whole = as_rows(catalogue.catalogue(rows))
    columns = catalogue.catalogue(rows).columns
    assert as_rows(catalogue.catalogue(rows, presort=False)) == whole
    for parts in (2, 5):
        shards = [catalogue.catalogue(rows.where(F.col("source_index") % parts == k)) for k in range(parts)]
        assert as_rows(catalogue.merge(*shards).select(*columns)) == whole
        nodes = [catalogue.merge(*shards[:1]), catalogue.merge(*shards[1:])]
        assert as_rows(catalogue.merge(*nodes[::-1]).select(*columns)) == whole


def test_resuming_a_range_counts_nothing_twice(spark, systems):
    rows = spark.createDataFrame([(k, k // 10, str(sorted(w)), w[0]) for k, w in enumerate(systems)], "source_index long, file long, key string, weight0 int")
    empty = catalogue.count_first(rows.where("false"), ["key"], ["weight0"])
    one, ledger = catalogue.resume(empty, rows.where("false").select("file"), rows.where("file < 4"), unit="file", key=["key"], payload=["weight0"])
    two, ledger = catalogue.resume(one, ledger, rows.where("file < 7"), unit="file", key=["key"], payload=["weight0"])
    three, ledger = catalogue.resume(two, ledger, rows, unit="file", key=["key"], payload=["weight0"])
    assert as_rows(three.select("key", "count", "source_index")) == as_rows(catalogue.count_first(rows, ["key"], ["weight0"]).select("key", "count", "source_index"))
    assert ledger.count() == 12


def test_accounting_balances(spark, systems):
    rows = resolved(spark, systems)
    failed = sum(max(w) * 2 > sum(w) for w in systems)
    for presort in (True, False):
        (r,) = catalogue.accounting(catalogue.classified(rows, schema.WEIGHTS, presort=presort)).collect()
        assert (r.processed, r.failed, r.balanced) == (120, failed, True)
    (r,) = catalogue.accounting(catalogue.classified(rows.where("false"), schema.WEIGHTS)).collect()
    assert (r.processed, r.unique, r.balanced) == (0, 0, True)


def test_combined_rows(spark):
    cells = {f"weight{r}_{c}": 0 for r in range(5) for c in range(10)} | {f"degree{r}": 0 for r in range(5)}
    row = {"source_index": 5, "structure_id": 3, "nw": 2, "N": 7, "degree0": 3, "degree1": 4, **{k: v for k, v in cells.items() if k not in ("degree0", "degree1")}}
    row |= {f"weight0_{c}": 1 for c in range(3)} | {f"weight1_{c}": 1 for c in range(3, 7)}
    make = lambda **more: spark.createDataFrame([row | more])
    df = schema.resolve_input(make())
    (r,) = df.collect()
    assert (r.source_index, r.profile_id, r.degrees, r.rows) == (5, 2, [3, 4], [[1, 1, 1, 0, 0, 0, 0], [0, 0, 0, 1, 1, 1, 1]])
    (c,) = catalogue.catalogue(df).collect()
    assert (c.vertex_count, c.facet_count, c.point_count) == (12, 7, 350)
    with pytest.raises(Exception, match="bad combined weight system"):
        schema.resolve_input(make(N=8)).collect()
    with pytest.raises(ValueError, match="missing"):
        schema.resolve_input(spark.createDataFrame([(1, 2)], "weight0 int, weight1 int"))


def test_functions(spark):
    rows = [[1, 1, 1, 1, 1, 1], [2, 4, 6, 8, 10, 12], [1, 3, 9, 27, 77, 117], [5, 5, 10, 15, 35, 70], [6, 10, 15, 21, 35, 14]]
    df = spark.createDataFrame([(w,) for w in rows], "w array<bigint>")
    w = F.col("w")
    got = df.select(W.total(w), W.common_divisor(w), W.canonical(w), W.multiplicities(w), W.gorenstein(w), W.may_be_interior(w), W.ones(w)).collect()
    for r, x in zip(got, rows, strict=True):
        g = int(np.gcd.reduce(x))
        assert list(r) == [sum(x), g, sorted(y // g for y in x), sorted((x.count(y) for y in set(x)), reverse=True), all(sum(x) % y == 0 for y in x), 2 * max(x) <= sum(x), x.count(1)]
    assert df.where("w[0] = 1").select(W.point_count(w)).toPandas().iloc[:, 0].tolist() == [462, 5901]
    assert spark.range(1).select(W.common_divisor(F.array(F.lit(2 * 3**38).cast("bigint"), F.lit(3**39).cast("bigint")))).first()[0] == 3**38
    big = 12200160415121876738
    (k,) = spark.createDataFrame([(bytearray(big.to_bytes(8, "big") + (7).to_bytes(8, "big")),)], "k binary").select(*catalogue.key_halves(F.col("k"))).collect()
    assert [int(x) for x in k] == [big, 7]


def test_generator(spark):
    got = {r.degree: r["count"] for r in generate.candidates(spark, 6, 14).groupBy("degree").count().collect()}
    assert got == {6: 1, 7: 1, 8: 2, 9: 3, 10: 5, 11: 6, 12: 9, 13: 12, 14: 17}
    direct = {lengths for lengths, shared in generate.combined_types() if shared == 0}
    assert direct == {(6,), (5, 2), (4, 3), (4, 2, 2), (3, 3, 2), (3, 2, 2, 2), (2, 2, 2, 2, 2)}
    r = spark.range(1).select(generate.with_half_weight(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")), generate.padded_row(F.array(F.lit(5)).cast("array<bigint>"), F.lit(2), F.lit(1))).first()
    assert list(r) == [[1, 2, 3], [0, 0, 5, 0]]


def test_enrichment(spark, systems):
    cat = catalogue.catalogue(resolved(spark, systems)).withColumn("extra", F.lit("x"))
    out = enrich.add_normal_forms(cat).collect()
    assert all(r.key_matches and r.extra == "x" for r in out)
    for r in out:
        form = np.array(enrich.unpacked(bytes(r.nf_vertices)))
        assert form.shape == (5, r.vertex_count)
        assert classify.nf_key([int(x) for x in form.ravel()]) == bytes(r.nf_key)
    bad = spark.createDataFrame([(1, 1, 1, 1, 1, 6)], V1)
    assert enrich.add_normal_forms(bad).first().nf_vertices is None
    wrong = cat.withColumn("nf_key", F.lit(b"0123456789abcdef"))
    assert not any(r.key_matches for r in enrich.add_normal_forms(wrong).collect())
    with pytest.raises(OverflowError):
        enrich.packed([1 << 31])


def test_positional_merge(spark):
    left = spark.createDataFrame([(g, r, g * 10 + r, 5, 1) for g in range(2) for r in range(3)], "source_row_group int, source_row_in_group int, count long, h11 int, keep int")
    right = spark.createDataFrame([(g, r, g + r) for g in range(2) for r in range(3)], "source_row_group int, source_row_in_group int, h11_c int")
    out = enrich.positional_merge(left, right, rename={"h11_c": "h11"})
    assert out.columns == ["source_row_group", "source_row_in_group", "keep", "h11", "count"]
    assert all(r.h11 == r.source_row_group + r.source_row_in_group for r in out.collect())
    assert enrich.positional_audit(left, right).first().aligned
    short = right.where("source_row_in_group < 2")
    audit = enrich.positional_audit(left, short.unionByName(short.limit(1))).first()
    assert (audit.left_rows, audit.right_rows, audit.left_only, audit.repeated, audit.aligned) == (6, 5, 2, 1, False)
    with pytest.raises(Exception, match="don't match by position"):
        enrich.positional_merge(left, short).collect()


def test_cascade(spark):
    r = random.Random(4)
    rows = [(k, r.randrange(8), r.randrange(3), r.randrange(4)) for k in range(196)] + [(900, 99, 0, 0), (901, None, 1, 2), (902, None, 1, 2), (903, None, 1, None), (904, 5, None, 3)]
    df = spark.createDataFrame(rows, "row_id long, a int, b int, deep_value int")
    seen = []
    deep = lambda d: (seen.append(1), d.withColumn("deep", F.col("deep_value")))[1]
    (rep,) = cascade.cascade_report(df, ["a", "b"], deep, "deep").collect()
    assert rep.distinct_keys == len({(a, b, d) for _, a, b, d in rows}) and rep.n_rows == 201 and rep.colliding == sum(sum(y[1:3] == x[1:3] for y in rows) > 1 for x in rows)
    left = cascade.cascade(df, ["a", "b"], deep, "deep").collect()
    same = lambda x: [y for y in rows if y[1:] == x[1:]]
    assert {(x.row_id, x.members) for x in left} == {(x[0], len(same(x))) for x in rows if len(same(x)) > 1}
    pairs = cascade.pairs_within(df, ["a", "b", "deep_value"], "row_id", []).count()
    assert pairs == sum(len(same(x)) - 1 for x in rows) // 2
    verdicts = {(v.a, v.b): v.verdict for v in cascade.verdicts(deep(df), ["a", "b"], "deep").collect()}
    for (a, b), v in verdicts.items():
        keys = [d for _, x, y, d in rows if (x, y) == (a, b)]
        assert v == ("RESOLVED" if len(set(keys)) == len(keys) else "STILL COLLIDING")
    blobs = spark.createDataFrame([(1, "x", "p"), (1, "y", "p"), (2, "z", "q")], "g int, blob string, points string")
    assert {r.g: (r.same_bytes, r.same_points) for r in cascade.identical_members(blobs, ["g"], "blob", "points").collect()} == {1: (False, True), 2: (True, True)}


def test_sampling(spark):
    values = list(range(1000))
    random.Random(5).shuffle(values)
    df = spark.createDataFrame([(v // 3, v) for v in values], "m int, v int")
    ranks = {r.v: r["rank"] for r in sampling.ranked(df, ["m", "v"]).collect()}
    assert ranks == {v: v for v in values}
    assert sorted(r.v for r in sampling.systematic(df, ["m", "v"], 7, 20).collect()) == list(range(0, 140, 7))
    assert [r.m for r in sampling.largest_groups(df.groupBy("m").count(), 2, "count", "m").collect()] == [0, 1]


def test_files(spark, tmp_path, systems):
    for k in range(4):
        spark.createDataFrame(systems[k * 30 : k * 30 + 30], V1).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        next((tmp_path / f"p{k}").glob("part-*.parquet")).rename(tmp_path / f"shard{k}.parquet")
    folder = f"file://{tmp_path}"
    df = files.read_weights(spark, folder, start=1, end=9, max_rows=7)
    got = sorted((r.source_index // files.FILE_STRIDE, r.source_index % files.FILE_STRIDE, tuple(r.rows[0])) for r in df.collect())
    assert got == [(f, k, systems[f * 30 + k]) for f in (1, 2, 3) for k in range(7)]
    assert files.first_rows(spark, folder, 3).count() == 3
    with pytest.raises(ValueError):
        files.read_weights(spark, folder, start=4)
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, f"{folder}/none")
    picked = files.by_position(spark.read.parquet(f"{folder}/shard2.parquet"), spark.createDataFrame([("shard2.parquet", 4)], "file_name string, row_index long"))
    assert [tuple(r)[2:] for r in picked.collect()] == [systems[64]]
    assert files.shard_ranges(10, 4) == [(0, 2), (3, 5), (6, 7), (8, 9)] and files.shard_ranges(2, 3) == [(0, 0), (1, 1)]


def test_text_sources(spark, tmp_path):
    path = tmp_path / "w.txt"
    path.write_text("6 1 1 1 1 1 1\n\n  14 1 1 1 3 4 4 M:651 9\n7 1 1 1 1 1 1\nx 1 2 3 4 5 6\n5 1 1\n")
    got = {r.line.split()[0]: r.ok for r in text.weight_lines(spark, str(path)).collect()}
    assert got == {"6": True, "14": True, "7": False, "x": False, "5": False}
    sample = {r.ws: r.point_count for r in text.sample_lines(spark, str(path)).collect()}
    assert sample["14 1 1 1 3 4 4"] == 651 and sample["6 1 1 1 1 1 1"] == 0
    block = "noise\n2 3  Normal form of vertices\n 1 0 2\n 0 1 -5\n"
    (tmp_path / "nf.txt").write_text(block * 2)
    got = text.normal_form_blocks(spark, str(tmp_path / "nf.txt")).orderBy("line").collect()
    assert [(r.line, r.height, r.width, r.nf) for r in got] == [(1, 2, 3, [[1, 0, 2], [0, 1, -5]]), (5, 2, 3, [[1, 0, 2], [0, 1, -5]])]
    for bad in ("2 3  Normal form of vertices\n1 0 2", "2 3  Normal form of vertices\n1 0 2\n1 2\n", "1 1 Normal form of vertices\nx\n"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(Exception, match="short or uneven"):
            text.normal_form_blocks(spark, str(tmp_path / "bad.txt")).collect()
    record = classify.golden_record([1, 1, 1, 1, 2, 2])
    sinks.write_golden(spark.createDataFrame([json.dumps(record)], "string").select(F.from_json("value", text.GOLDEN).alias("r")).select("r.*"), str(tmp_path / "golden"))
    (back,) = text.golden_records(spark, str(tmp_path / "golden")).collect()
    assert back.nf == record["nf"] and back.digests == record["digests"] and back.bytes_len == 8 * 5 * back.nv


def test_digest_of_normal_form_is_native(spark):
    import hashlib

    flat = [1, -2, 0, 3**30, -(2**62)]
    df = spark.createDataFrame([(flat,)], "nf array<bigint>")
    assert df.select(classify.sha256_of_normal_form(F.col("nf"))).first()[0] == hashlib.sha256(normal_form_bytes(np.array(flat, dtype=object))).hexdigest()


def test_sinks(spark, tmp_path, systems):
    rows = resolved(spark, systems)
    cat = catalogue.catalogue(rows, reflexive=True)
    sinks.write_catalogue(cat, str(tmp_path / "c"), reflexive=True)
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.columns == [*schema.CATALOGUE, *schema.REFLEXIVE_ONLY] and as_rows(back.select(*cat.columns)) == as_rows(cat)
    keys = [bytes(r.nf_key) for f in sorted((tmp_path / "c").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
    assert keys == sorted(keys)
    for _ in range(2):
        sinks.write_run(cat, str(tmp_path / "runs"), "a-00003", files=["x"])
    assert sinks.run_files(spark, str(tmp_path / "runs")) == {"a-00003": ["x"]} and sinks.run_files(spark, str(tmp_path / "none")) == {}
    assert as_rows(catalogue.merge(spark.read.parquet(str(tmp_path / "runs")).drop("run")).select(*cat.columns)) == as_rows(cat)
    sinks.write_metrics(catalogue.classified(rows, schema.WEIGHTS), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().processed == 120
    one, two = spark.range(5).select("id"), spark.range(100, 103).select("id")
    sinks.concatenate([two, one], str(tmp_path / "one"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "one")).collect()] == [100, 101, 102, 0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="schemas differ in id"):
        catalogue.strict_union(one, two.select(F.col("id").cast("int")))


def test_stream(spark, tmp_path, systems):
    spark.createDataFrame(systems, V1).repartition(4).write.parquet(str(tmp_path / "in"))
    shape = spark.read.parquet(str(tmp_path / "in")).schema
    run = lambda: incremental.follow(spark, str(tmp_path / "in"), shape, str(tmp_path / "runs"), str(tmp_path / "state"), files_per_batch=1).awaitTermination(120)
    run()
    spark.createDataFrame(systems[:50], V1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = sorted((bytes(r.nf_key), r["count"]) for r in incremental.compact(spark, str(tmp_path / "runs"), str(tmp_path / "all")).collect())
    want = sorted((bytes(r.nf_key), r["count"]) for r in catalogue.catalogue(resolved(spark, systems + systems[:50])).collect())
    assert got == want


def test_kernels_and_deep_keys(spark):
    assert classify.kernel("auto") is classify.array_batch
    with pytest.raises(ValueError, match="no kernel"):
        classify.kernel("cuda")
    part = spark.range(40).select(F.col("id").alias("p_partkey"))
    tried = catalogue.classified(weight_rows(part, F.col("p_partkey"), FEW), schema.WEIGHTS).where("ok").dropDuplicates(["nf_key"])
    keyed = classify.fingerprints(tried.select("nf_key", "nf")).collect()
    assert len({r.full_key for r in keyed}) == len(keyed)
    pairs = spark.createDataFrame([(list(keyed[0].nf), list(keyed[0].nf)), (list(keyed[0].nf), list(keyed[1].nf)), (list(keyed[0].nf), None)], "nf_a array<bigint>, nf_b array<bigint>")
    assert [r.verdict for r in classify.isomorphic_pairs(pairs).collect()] == ["EQUIVALENT", "INEQUIVALENT", None]


def test_hodge_columns_and_dump(spark, systems):
    rows = resolved(spark, [*systems, (1, 1, 1, 1, 1, 2)])
    forms = catalogue.classified(rows, schema.WEIGHTS)
    out = classify.with_hodge(forms.select("ok", "nf", "point_count", F.lit(5).alias("h11"))).collect()
    assert {r.h11 for r in out if r.point_count == 462} == {1, 2}
    assert all(r.reflexive is None and r.h11 is None for r in out if not r.ok)
    assert [r.chi for r in out if r.point_count == 496] == [None]
    assert classify.dump("6 1 1 1 1 1 1").startswith("5 6 ") and classify.dump("7 1 1 1 1 1 1") == "FAIL" == classify.dump("11 1 1 1 1 1 6")


def test_group_verdicts_and_mass(spark):
    pairs = spark.createDataFrame([(1, "INEQUIVALENT"), (1, "INEQUIVALENT"), (2, "EQUIVALENT"), (2, "TOO_BIG"), (3, "TOO_BIG"), (3, "INEQUIVALENT")], "g int, verdict string")
    assert {r.g: r.verdict for r in cascade.pair_verdicts(pairs, ["g"]).collect()} == {1: "DISTINCT", 2: "DUPLICATES", 3: "OPEN"}
    df = spark.createDataFrame([(5, 1), (5, 4), (7, 1)], "nv int, count long")
    assert [tuple(r) for r in cascade.fibre_mass(df, "count", "nv").orderBy("nv").collect()] == [(5, 2, 5, 4, 1, 5), (7, 1, 1, 1, 1, 6)]


def test_scopes_delete_their_own_tables_alone(spark):
    import threading

    from polycat.storage import Scope, Workspace

    made, opened, saved = {}, threading.Event(), threading.Event()

    def other():
        with Scope(spark):
            opened.set()
            made["other"] = Workspace(spark, "other").save(spark.range(3), "t")
            saved.set()
            closed.wait(60)
            made["count"] = made["other"].count()

    closed = threading.Event()
    thread = threading.Thread(target=other)
    with Scope(spark) as scope:
        thread.start()
        opened.wait(60)
        work = Workspace(spark, "mine")
        mine = work.save(spark.range(5), "t")
        work.save(spark.range(2), "u")
        work.keep("t")
        saved.wait(60)
        assert mine.count() == 5 and len(scope.made) == 1
    closed.set()
    thread.join()
    assert made["count"] == 3
    with pytest.raises(Exception, match="(?i)exist|FAILED_READ"):
        mine.collect()


def test_intermediate_tables_are_nothing_but_their_parts(spark):
    import os

    from polycat.storage import Scope, Workspace

    with Scope(spark):
        work = Workspace(spark, "bare")
        rows = work.save(spark.range(100).repartition(3), "t")
        # Hadoop starts a process for each file that it makes in a plain folder.
        files = os.listdir(f"{work.base.removeprefix('file://')}/t")
        assert len(files) == 3 and all(f.startswith("part-") for f in files)
        assert sorted(r.id for r in rows.collect()) == list(range(100))
        work.save(spark.range(7), "t")  # over what is there
        assert len(os.listdir(f"{work.base.removeprefix('file://')}/t")) == spark.range(7).rdd.getNumPartitions() and work.spark.read.parquet(f"{work.base}/t").count() == 7


def gorenstein(low, high):
    from itertools import combinations_with_replacement

    return [w for w in combinations_with_replacement(range(1, high), 6) if low <= sum(w) <= high and all(sum(w) % x == 0 for x in w) and np.gcd.reduce(w) == 1]


@pytest.mark.parametrize("trust", [False, True])
def test_sieve_finds_the_classes_of_the_catalogue(spark, trust):
    from polycat.operators import sieve

    r = random.Random(3)
    some = [tuple(r.choice([1, 1, 2, 3, 4, 6]) for _ in range(6)) for _ in range(150)] + [(1, 1, 1, 1, 1, 1), (2, 2, 2, 2, 2, 2), (1, 1, 2, 2, 2, 4)] * 2
    df = spark.createDataFrame([(list(w),) for w in some] + [(None,), ([1, 2],), ([0, 1, 1, 1, 1, 1],)], "ws array<bigint>")
    got = {tuple(x.canonical): x for x in sieve.sieve(df, trust_local=trust).collect()}
    like = lambda w: tuple(sorted(np.array(w) // np.gcd.reduce(w)))
    forms = {}
    for w in {like(w) for w in some}:
        p, _ = classify.polytope_of([list(w)])
        if p is not None:
            forms[w] = str(normal_form(p).tolist())
    assert set(got) == set(forms)
    for w, x in got.items():
        mates = [v for v in forms if forms[v] == forms[w]]
        assert x.members == sum(like(v) == w for v in some)
        assert x.class_systems == len(mates) and x.verdict == ("SAME" if len(mates) > 1 else "DIFFERENT")
        assert x.class_id == min(" ".join(map(str, v)) for v in mates)
    stages = {x.stage for x in got.values()}
    assert stages <= {"S2", "S3", "S4", "S5", "S6"} and stages & {"S4", "S5"}
    assert sieve.sieve(df.where("false")).count() == 0


def test_signatures_are_of_the_polytope_and_simplices_are_told_by_their_circuit():
    from polycat.kernel.polytope import hull
    from polycat.operators.sieve import signature

    rng = np.random.default_rng(1)
    for w in [(1, 1, 1, 1, 1, 1), (1, 1, 1, 3, 4, 4), (1, 1, 1, 1, 1, 2)]:
        p, points = classify.polytope_of([list(w)])
        for _ in range(3):
            assert signature(hull(moved(p.vertices, rng)), points) == signature(p, points)
    # Vertices that generate the lattice: the dual of a projective space.
    simplex = hull(np.concatenate([np.eye(5, dtype=np.int64), -np.ones((1, 5), np.int64)]))
    assert signature(simplex, 7)[:2] == ("S3", True)


def test_cascade_with_real_keys(spark, tmp_path):
    from polycat.operators import fibres

    part = spark.range(1, 400).select(F.col("id").alias("p_partkey"))
    cat = catalogue.catalogue(weight_rows(part, F.col("p_partkey")))
    rich = enrich.add_normal_forms(cat).withColumn("bh_mv", F.col("vertex_count")).withColumn("row_id", F.col("source_index")).cache()
    free = ["bh_mv", "facet_count"]
    rows = rich.collect()
    keyed = {x.row_id: x for x in fibres.geometry_key(rich).collect()}
    group = lambda x: (x.bh_mv, x.facet_count)
    tested = [x for x in rows if sum(group(y) == group(x) for y in rows) > 1]
    (report,) = fibres.completeness(rich, free).collect()
    assert (report.n_rows, report.colliding, report.free_groups) == (len(rows), len(tested), len({group(x) for x in rows}))
    assert report.distinct_keys == len({(*group(x), keyed[x.row_id].geometry_key) for x in rows})
    assert report.nonreflexive_tested == sum(not keyed[x.row_id].reflexive for x in tested)
    left = fibres.residual(rich, free)
    full = lambda x: (*group(x), keyed[x.row_id].geometry_key)
    stay = {x.row_id for x in rows if sum(full(y) == full(x) for y in rows) > 1}
    assert {x.row_id for x in left.collect()} == stay
    sinks.write_residual(left, fibres.completeness(rich, free), str(tmp_path / "r"), stratum=F.col("bh_mv"))
    assert {x.row_id for x in spark.read.parquet(str(tmp_path / "r/rows")).collect()} == stay
    assert spark.read.json(str(tmp_path / "r/summary")).first().n_rows == len(rows)
    # Two copies of one polytope in a group: the same bytes, points and signs.
    twice = rich.limit(3).unionByName(rich.limit(3)).withColumn("nf", F.lit(None).cast("array<bigint>"))
    forms = catalogue.classified(weight_rows(part, F.col("p_partkey")), schema.WEIGHTS).where("ok").select("nf_key", "nf").dropDuplicates(["nf_key"])
    twice = twice.drop("nf").join(forms, "nf_key")
    assert all(x.same_bytes and x.same_points and not x.signs_differ for x in fibres.diagnostics(twice, ["nf_key"]).collect())
    assert fibres.cheap_keys(rich, free).select("cheap_key").distinct().count() == len({full(x) for x in rows})


def test_hot_groups_are_split(spark):
    """A key with most of the rows: Spark splits its partition in the joins of a cascade."""
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.range(60000, numPartitions=8).select("id", F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id") % 5000).alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        out = cascade.collisions(df, ["a"])
        assert out.count() == 60000
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_search_by_adding_points(spark):
    got = [tuple(r.weights) for r in generate.search(spark, 3).collect()]
    assert sorted(got) == [(1, 1, 1), (1, 1, 2), (1, 2, 3)]
    assert generate._name([(1, 1, 1), (0, 2, 1), (3, 0, 0)]) == generate._name([(0, 3, 0), (1, 0, 2), (1, 1, 1)])
    four = generate.search(spark, 4).collect()
    assert len(four) == 95 and max(r.degree for r in four) == 66 and all(r.degree == sum(r.weights) for r in four)


def test_a_search_goes_on_where_it_was_stopped(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "four")
    assert generate.search(spark, 4, folder, levels=2).count() < 95
    kept = {p.name for p in tmp_path.rglob("part-*")}
    # The third level is begun, and lost before it was finished.
    (tmp_path / "four" / "level=2").mkdir()
    (tmp_path / "four" / "level=2" / "part-0.parquet").write_bytes(b"half")
    assert generate.search(spark, 4, folder).count() == 95
    assert kept <= {p.name for p in tmp_path.rglob("part-*")}
    # Five weights: the first levels' systems are some of all.
    five = str(tmp_path / "five")
    first = {tuple(r.weights) for r in generate.search(spark, 5, five, levels=1).collect()}
    two = {tuple(r.weights) for r in generate.search(spark, 5, five, levels=2).collect()}
    assert first == {(1, 1, 1, 1, 1)} < two and all(2 * max(w) <= sum(w) for w in two)


def test_algebra_on_columns(spark):
    from polycat.operators import algebra

    rows = [[[2, 1], [4, 6]], [[0, 0], [0, 0]], None]
    df = spark.createDataFrame([(m,) for m in rows], "m array<array<bigint>>")
    out = algebra.with_integer_kernel(algebra.with_smith_factors(algebra.with_determinant(df, "m"), "m"), "m").collect()
    assert [(r.determinant, r.smith_factors, r.integer_kernel) for r in out] == [(8, [1, 8], []), (0, [], [[1, 0], [0, 1]]), (None, None, None)]


def test_classes_by_representatives_are_those_of_all_pairs(spark):
    draw = random.Random(5)
    rows = [(k, draw.choice(["a", "b", None]), draw.randint(0, 9), draw.choice([0, 1])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, x int, h int")
    tests = []

    def tested(pairs):
        tests.append(pairs.count())
        # A null for some pairs of different rows.
        same = F.when(F.col("x_a") == F.col("x_b"), True).when(F.col("x_a") + F.col("x_b") < 17, False)
        return pairs.withColumn("same", same)

    got = {r.id: r for r in cascade.classes_within(df, ["g", "h"], "id", ["x"], tested).collect()}
    assert len(got) == 300
    for k, g, x, h in rows:
        mates = [r[0] for r in rows if r[1:] == (g, x, h)]
        assert (got[k].class_id, got[k].links, got[k].g, got[k].h) == (min(mates), len(mates) - 1, g, h)
    assert sum(r.undecided for r in got.values()) > 0
    # Rows times classes, not all pairs.
    assert len(tests) <= 10 and sum(tests) < 300 * 10 / 1.5
    assert cascade.classes_within(df.where("false"), ["g"], "id", ["x"], tested).count() == 0


def test_isomorphism_classes(spark):
    from polycat.kernel.polytope import hull
    from polycat.operators.classify import polytope_of

    rng, rows = np.random.default_rng(4), []
    for k, w in enumerate([(1, 1, 1, 1, 1, 1), (1, 1, 2, 2, 2, 4), (1, 1, 1, 1, 1, 2), (1, 1, 1, 1, 2, 3)]):
        p, _ = polytope_of([list(w)])
        for j in range(4):
            v = moved(p.vertices, rng) if j else p.vertices
            assert hull(v) is not None
            rows.append((f"{k}-{j}", len(v), [int(x) for x in v.T.ravel()]))
    forms = spark.createDataFrame(rows, "nf_key string, vertex_count int, nf array<long>")
    got = {r.nf_key: (r.class_id, r.links, r.undecided) for r in classify.isomorphism_classes(forms, ["vertex_count"]).collect()}
    assert got == {key: (f"{key[0]}-0", 3, 0) for key, _, _ in rows}


def test_what_the_cascade_leaves_of_all_rows_are_those_of_one_key(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    left = sorted((r.members, r.first) for r in entry.queries()["fibre_residual"](spark, sf).collect())
    want = sorted((r["count"], r.source_index) for r in catalogue.catalogue(weight_rows(spark.read.parquet(f"{sf}/part.parquet"), F.col("p_partkey"), MANY)).where("count > 1").collect())
    assert left == want and left


def test_resuming_does_not_deal_rows_by_file(spark):
    """With a ledger too large for Spark to send by itself, too: the rows of one file aren't one task's."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select(F.col("id").alias("source_index"), (F.col("id") % 1 + 1).cast("int").alias("file"), (F.col("id") % 3).alias("key"))
        none = rows.where("false")
        ledger = spark.range(5, 8).select(F.col("id").cast("int").alias("file"))
        out, _ = catalogue.resume(catalogue.count_first(none, ["key"], []), ledger, rows, unit="file", key=["key"], payload=[])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(tuple(r) for r in out.select("key", "count", "source_index").collect()) == [(0, 334, 0), (1, 333, 1), (2, 333, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
