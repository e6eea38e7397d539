import random
import re

import numpy as np
import pyarrow as pa
import pytest

from polycat.llm import minhash
from polycat.llm.arrays import text_bytes

SCHEMA = "doc_id long, text string, n string, node string, label string"


def shingle_set(text, width=5):
    words = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        low.setdefault(root(k), []).append(d)
    return sorted((str(d), len(sets[k]), str(min((x for x in low[root(k)] if x is not None), default=None))) for k, (d, _) in enumerate(rows))


def test_sets_are_those_of_the_words():
    texts = ["a b c d e f", "A B  c\td e f", "a b", "b a", "", " \n", None, "a a a a a a a a", "é É x y z w"]
    values, first = minhash.shingles(*text_bytes(pa.array(texts)), 5)
    sets = [values[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert (sets[0] == sets[1]).all() and not (sets[2] == sets[3]).all()


def test_overlaps():
    r = np.random.default_rng(1)
    some = [np.unique(r.integers(0, 9000, r.integers(1, 9000))) for _ in range(7)]
    lists = lambda s: minhash._lists(np.concatenate(s).astype(np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in s])]))
    want = [[len(np.intersect1d(a, b)) for b in some[4:]] for a in some[:4]]
    assert minhash.overlaps(lists(some[:4]), lists(some[4:])).tolist() == want


@pytest.mark.parametrize("percent", [80, 85])
def test_groups(spark, percent, monkeypatch):
    r = random.Random(percent)
    word = lambda: f"w{r.randint(0, 4000)}"
    base = [word() for _ in range(80)]
    rows = []
    for k in range(220):  # one large family, each member a few words apart: chains of links, not cliques
        text = list(base)
        for _ in range(r.randint(0, 3)):
            text[r.randrange(80)] = word()
        rows.append((k, " ".join(text)))
    for k in range(300, 340):
        text = [word() for _ in range(40)]
        rows += [(k, " ".join(text)), (k + 100, " ".join(text).upper().replace("W", " w ").replace(" w ", "w", 0)), (k + 200, " ".join(text[:-1]))]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two  words"), (905, "x " * 30000), (906, "x " * 40000), (None, "two words"), (None, "alone here"), (903, "two words")]
    docs = spark.createDataFrame([(d, t, "a", "b", "c") for d, t in rows], SCHEMA)
    import polycat.llm.minhash as m

    monkeypatch.setattr(m, "BLOCK", 16)
    out = m.near_duplicates(docs, percent=percent).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in out) == brute(rows, percent)
    kept = [x for x in out if x.kept]
    groups = {x.component_id for x in out if x.n_shingles and x.component_id is not None}
    assert len([x for x in kept if x.n_shingles and x.component_id is not None]) == len(groups)
    assert all(x.kept for x in out if not x.n_shingles)
    assert all(x.doc_id == x.component_id for x in kept)
    assert m.near_duplicates(docs.where("false")).count() == 0


def test_dropping_keeps_all_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "a", 1), (2, text + " x", "b", 2), (3, "other words here", "c", 3), (3, "other words here", "d", 4), (4, None, "e", 5), (4, None, "f", 6), (None, "quite alone", "g", 7), (3, "a third text", "h", 8)]
    docs = spark.createDataFrame(rows, "_id long, text string, _key string, _copies int")
    out = minhash.drop_near_duplicates(docs, doc_id="_id")
    assert out.columns == docs.columns
    got = sorted(r._key for r in out.collect())
    assert len(got) == 6 and {"a", "e", "f", "g", "h"} <= set(got) and len({"c", "d"} & set(got)) == 1
    assert minhash.drop_near_duplicates(docs.where("false"), doc_id="_id").count() == 0


def test_components_of_long_chains_and_stars(spark, tmp_path):
    r = random.Random(9)
    b = lambda k: bytes([k // 256, k % 256])
    chain = [(b(k), b(k + 1)) for k in range(0, 100)]
    star = [(b(500), b(k)) for k in range(300, 480)]
    edges = chain + star + [(b(700), b(701)), (b(701), b(702)), (b(702), b(700))]
    r.shuffle(edges)
    links = spark.createDataFrame(edges, "a binary, b binary")
    got = {bytes(x.node): bytes(x.label) for x in minhash.components(links, minhash.Workspace(spark, "test"), "t").collect()}
    want = {b(k): b(0) for k in range(101)} | {b(k): b(300) for k in [*range(300, 480), 500]} | {b(k): b(700) for k in (700, 701, 702)}
    assert got == want
