import json
import os
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from jobs import follow_records, worklist
from polycat.operators import buckets
from polycat.operators.catalogue import catalogue
from polycat.plans.derive import MANY
from polycat.schema import WEIGHTS, resolve_input

ROOT = Path(__file__).parents[2]
DATA = "/root/testdata/sf0.001"
LINES = {"kind": "lines", "index": "doc_id", "text": "text", "buckets": 64, "files_per_batch": 2}


def put(df, folder, name):
    """A file of a folder, copied in under its name."""
    pq.write_table(df.toArrow(), f"{folder}/.{name}")
    os.rename(f"{folder}/.{name}", f"{folder}/{name}.parquet")


def files_of(folder):
    """The data files under a folder by partition."""
    out = defaultdict(set)
    for path in Path(folder).rglob("*.parquet"):
        out[path.parent.name].add(path.name)
    return out


def lines_by_hand(rows):
    count, first = Counter(), {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            line = re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line)
            if line:
                count[line] += 1
                first[line] = min(doc, first.get(line, doc))
    return sorted((count[x], first[x], len(x)) for x in count)


def found_lines(spark, target):
    rows = buckets.read(spark, target)
    assert rows.select("key").distinct().count() == rows.count()
    return sorted((r["count"], r.source_index, r.chars) for r in rows.collect())


def test_lines_of_a_growing_folder(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(5000, None), (5001, ""), (5002, " \n\t\n"), (5003, "once\n once \r\nonce"), (-7, "once")], "doc_id long, text string")
    parts = [docs.where(f"doc_id % 3 = {k}").select("doc_id", "text") for k in range(3)] + [odd]
    rows = []
    for k, part in enumerate(parts[:3]):
        put(part, source, k)
        rows += [tuple(r) for r in part.collect()]
    done = follow_records.follow(spark, LINES, source, target, state)
    assert done["batches"] == 2 and done["records"] == sum(t.count("\n") + 1 for _, t in rows if t is not None)
    assert found_lines(spark, target) == lines_by_hand(rows)
    before = files_of(f"{target}/catalogue")
    # Nothing new: nothing is done.
    assert follow_records.follow(spark, LINES, source, target, state)["batches"] == 0
    assert files_of(f"{target}/catalogue") == before
    # Few new records: few buckets are written.
    put(odd, source, 3)
    rows += [tuple(r) for r in odd.collect()]
    done = follow_records.follow(spark, LINES, source, target, state)
    assert (done["batches"], done["records"], done["rejected"], done["keys"], done["touched"]) == (1, 8, 4, 1, 1)
    assert found_lines(spark, target) == lines_by_hand(rows)
    after = files_of(f"{target}/catalogue")
    assert len([b for b in after if after[b] != before.get(b)]) == 1


def test_a_batch_that_failed_is_taken_again(spark, tmp_path, monkeypatch):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    rows = [(1, "a\nb"), (2, "b\nc")]
    put(spark.createDataFrame(rows, "doc_id long, text string"), source, 0)
    follow_records.follow(spark, LINES, source, target, state)
    put(spark.createDataFrame([(3, "c\nd")], "doc_id long, text string"), source, 1)

    def fails(*tables, key):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "merge", fails)
        with pytest.raises(Exception, match="lost"):
            follow_records.follow(spark, LINES, source, target, state)
    assert found_lines(spark, target) == lines_by_hand(rows)
    for _ in range(2):
        follow_records.follow(spark, LINES, source, target, state)
        assert found_lines(spark, target) == lines_by_hand([*rows, (3, "c\nd")])


def systems_of(spark, n=300):
    rows = [(k, *(1 + k * (j + 3) % m for j, m in enumerate(MANY))) for k in range(n)]
    return spark.createDataFrame([*rows, (n, 0, 1, 1, 1, 1, 1), (n + 1, None, 1, 1, 1, 1, 1)], "source_index long, " + ", ".join(f"{c} int" for c in WEIGHTS))


@pytest.mark.parametrize("kind", ["weights", "polytopes"])
def test_weight_systems_of_a_growing_folder(spark, tmp_path, kind):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    rows = systems_of(spark)
    config = {"kind": kind, "index": "source_index", "buckets": 8}
    done = Counter()
    for part in ("source_index < 200", "source_index >= 200"):
        put(rows.where(part), source, part[-6:].strip())
        done.update(follow_records.follow(spark, config, source, target, state))
    assert (done["batches"], done["records"], done["rejected"]) == (2, 302, 2)
    got = buckets.read(spark, target).drop("bucket")
    if kind == "polytopes":
        want = catalogue(resolve_input(rows.where("source_index < 300")))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    else:
        assert got.agg({"count": "sum"}).first()[0] == 300 and got.count() == got.select("key").distinct().count()


def test_a_configuration_may_name_the_schema_of_an_empty_folder(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    config = LINES | {"schema": "doc_id long, text string"}
    assert follow_records.follow(spark, config, source, target, state)["batches"] == 0
    put(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), source, 0)
    done = follow_records.follow(spark, config, source, target, state)
    assert (done["batches"], done["records"], done["rejected"], done["keys"]) == (1, 1, 1, 0)
    put(spark.createDataFrame([(1, "a")], "doc_id long, text string"), source, 1)
    assert follow_records.follow(spark, config, source, target, state)["keys"] == 1


CONFIG = {"index": "source_index", "band": 8}


def test_worklist(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    systems_of(spark, 2000).write.parquet(source)
    numbers = worklist.worklist(spark, CONFIG, source, target)
    rows = worklist.read(spark, target).collect()
    assert (numbers["rows"], numbers["rejected"], numbers["systems"]) == (2002, 2, len(rows))
    assert sum(r["count"] for r in rows) == 2000 and len({r.system for r in rows}) == len(rows)
    local = Counter((r.n_distinct, r.multiplicities, r.n_ones, r.gorenstein) for r in rows if r.status != "no_interior")
    for r in rows:
        w = [int(x) for x in r.system.split()]
        assert r.degree == sum(w) and r.band == r.degree // 8 and (r.status == "no_interior") == (2 * max(w) > r.degree)
        if r.status != "no_interior":
            assert r.sharing == local[r.n_distinct, r.multiplicities, r.n_ones, r.gorenstein] and (r.status == "alone") == (r.sharing == 1)
    report = {r.status: (r.systems, r.rows) for r in spark.read.json(f"{target}/report").collect()}
    assert report == {s: (sum(r.status == s for r in rows), sum(r["count"] for r in rows if r.status == s)) for s in {r.status for r in rows}}
    # Again, whole and in part: the same rows; of a part only its bands are written.
    worklist.worklist(spark, CONFIG, source, target)
    assert sorted(map(str, worklist.read(spark, target).collect())) == sorted(map(str, rows))
    before = files_of(f"{target}/systems")
    worklist.worklist(spark, CONFIG, source, target, bands=[3])
    assert sorted(map(str, worklist.read(spark, target).collect())) == sorted(map(str, rows))
    by_path = {p for p in Path(f"{target}/systems").rglob("*.parquet")}
    assert {p.parent.name for p in by_path if p.name not in before[p.parent.name]} == {"band=3"}


def test_worklist_of_no_rows(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    systems_of(spark, 0).where("false").write.parquet(source)
    assert worklist.worklist(spark, CONFIG, source, target)["systems"] == 0
    assert spark.read.json(f"{target}/report", schema="status string").count() == 0


@pytest.mark.parametrize("job", ["follow_records", "worklist"])
def test_command_lines(tmp_path, job):
    table = "documents" if job == "follow_records" else "lineitem"
    more = ["--checkpoint", str(tmp_path / "state")] if job == "follow_records" else ["--bands", "2", "3"]
    command = [sys.executable, "-m", f"jobs.{job}", "--source", f"{DATA}/{table}.parquet", "--target", str(tmp_path / "out"), *more]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(ROOT), "SPARK_MASTER": "local[2]"}, timeout=300)
    assert done.returncode == 0, done.stderr
    assert "wrote" in done.stderr and json.loads((ROOT / f"jobs/{job}.json").read_text())
    assert list((tmp_path / "out").rglob("*.parquet"))
