import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from polycat.llm import fingerprints as fp
from polycat.llm import lines as ln

SCHEMA = "doc_id long, text string, row string, _id string, keep string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, None, "x", "y") for d, t in rows], SCHEMA)


def collapse(t):
    return re.sub(r"[ \t-\r]+", " ", t or "")


def test_hash_of_the_whole_is_combined_from_its_parts():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(5000))
    hashed = lambda b: fp.fingerprints(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].tolist()
    for cut in (0, 1, 1023, 1024, 1025, 3000, 5000):
        a, b = hashed(data[:cut]), hashed(data[cut:])
        assert [fp.combine(x, cut, y, p) for x, y, p in zip(a, b, fp.POINTS, strict=True)] == hashed(data)
    assert hashed(data) == [sum((v + 1) * pow(p, k, fp.MODULUS) for k, v in enumerate(data)) % fp.MODULUS for p in fp.POINTS]


@pytest.mark.parametrize("modulus", [fp.MODULUS, 3])
def test_exact_duplicates(spark, modulus):
    r = random.Random(2)
    rows = [(k, "".join(r.choice("ab \n") for _ in range(r.randint(0, 5)))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "   "), (None, "ab"), (None, "ab"), (1003, "long " * 40000), (1004, "long\t" * 40000), (1005, "long " * 39999 + "lonh ")]
    rows += [(7, rows[7][1])]
    points = tuple(p % modulus for p in fp.POINTS)
    out = fp.exact_duplicates(table(spark, rows), points=points, modulus=modulus).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[collapse(t)].append(d)
    want = sorted((str(d), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    assert sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.text_sha256) for x in out) == want
    kept = [x for x in out if x.kept]
    assert len(kept) == len(groups) and all(x.doc_id == x.keep_id for x in kept)
    assert fp.exact_duplicates(table(spark, rows).where("false")).count() == 0


def brute(rows, least, copies):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))
    who = defaultdict(set)
    order = lambda d: -1 if d is None else d
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                who[key(line)].add(order(d))
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [not (len(key(x)) >= least and len(who[key(x)]) >= copies and order(d) != max(who[key(x)])) for x in lines]
        out[d, t] = (len(lines), keep.count(False), "\n".join(x for x, k in zip(lines, keep, strict=True) if k), keep)
    return out


@pytest.mark.parametrize("batch", [7, 10000])
def test_shared_lines(spark, batch):
    r = random.Random(batch)
    some = ["Éa long line", " a Long line\t", "a long line", "short", "", "another longer line", "　wide line here"] + [f"line number {k:03}" for k in range(40)]
    rows = [(k, "\n".join(r.choice(some) for _ in range(r.randint(1, 9)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "a long line\n" * 500), (None, "a long line\nx"), (3, rows[3][1]), (4, "a long line\n other text"), (205, "line number 001\r\nline number 001\r")]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = table(spark, rows)
        marks = ln.shared_lines(docs, least=10, copies=5)
        want = brute(rows, 10, 5)
        got = marks.collect()
        assert sorted((str(x.doc_id), x.n_lines, x.n_dropped) for x in got) == sorted((str(d), n, m) for (d, _), (n, m, _, _) in want.items())
        assert all((x.keep is None) == (x.n_dropped == 0) for x in got)
        assert all(np.unpackbits(np.frombuffer(zlib.decompress(x.keep), np.uint8), count=x.n_lines).sum() == x.n_lines - x.n_dropped for x in got if x.keep)
        out = ln.apply_bitmaps(docs, marks).collect()
        assert out[0].asDict().keys() == {*docs.columns, "_n_lines", "_n_dropped"}
        assert sorted((str(x.doc_id), x.text or "") for x in out) == sorted((str(d), want[d, t][2]) for d, t in rows)
        assert ln.shared_lines(docs.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_only_texts_that_lose_lines_are_shuffled(spark):
    shared = "a line that stands in a good many documents, and is long"
    rows = [(k, f"own line {k}\n{shared}" if k % 50 == 0 else f"own line {k} and nothing that others have, however long it may be") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = ln.apply_bitmaps(docs, ln.shared_lines(docs, copies=5))
    got = {r.doc_id: (r.text, r._n_lines, r._n_dropped) for r in out.collect()}
    assert got == {k: (f"own line {k}", 2, 1) if k % 50 == 0 and k != 1950 else (t, t.count("\n") + 1, 0) for k, t in rows}
    # Below the rows that the filter lets by there is an exchange, below the others none but the one made here.
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    first, second = plan[: plan.index("Filter NOT")].rsplit("FileScan", 1)
    assert "SortMergeJoin" in first and "hashpartitioning(_id" in first
    assert "hashpartitioning" not in second and "Join" not in second
