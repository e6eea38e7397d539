import hashlib
import random

import numpy as np
import pytest

from polycat.llm import sketches
from polycat.llm.sketches import FLOOR, LIMIT, WIDTH, Sketch, compare, merge, parse


def shingles(text):
    return {text[k : k + WIDTH] for k in range(max(1, len(text) - WIDTH + 1))} if text else set()


def bytes_of(text):
    return np.frombuffer(text.encode(), np.uint8)


def sketch(text):
    return sketches._one(sketches.code_points(bytes_of(text)))


def hashed(text):
    """All hashes of a text, each shingle on its own."""
    if not text:
        return []
    return sorted({int(sketches._hashes(sketches.code_points(bytes_of(s)), np.array([0, len(s)]))[0][0]) for s in shingles(text)})


def words(draw, n, alphabet="abcdefghijklmnopqrstuvwxyzé日"):
    return " ".join("".join(draw.choice(alphabet) for _ in range(draw.randint(1, 9))) for _ in range(n))


def exact(one, two):
    a, b = shingles(one), shingles(two)
    return (len(a & b) / len(a | b) if a | b else 1.0), (len(a & b) / len(a) if a else 1.0)


@pytest.mark.parametrize("n", [0, 1, 3, 12, 200, 4000])
def test_a_sketch_keeps_all_low_hashes_and_the_least(n):
    text = words(random.Random(n), n)
    every = hashed(text)
    got = sketch(text)
    low = [h for h in every if h < LIMIT]
    assert got.hashes.tolist() == (low if len(low) > FLOOR else every[:FLOOR])
    assert got.whole == (len(got.hashes) == len(every))
    assert str(parse(str(got))) == str(got)


def test_many_texts_at_once_are_like_each_on_its_own():
    draw = random.Random(4)
    texts = ["", "a", "aaaaa", "aaaaaaaaaaaaaaaaaaa", "日本語日本語日本語", *(words(draw, draw.randint(0, 300)) for _ in range(60)), words(draw, 3000), ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    made = sketches.sketches(sketches.code_points(data), np.cumsum([0, *map(len, texts)]))
    assert [str(m) for m in made] == [str(sketch(t)) for t in texts]


def test_sketches_merge():
    draw = random.Random(8)
    for n, m in [(0, 0), (0, 5), (3, 4), (30, 2), (500, 3), (2500, 2500), (3000, 20)]:
        one, two = words(draw, n), words(draw, m)
        both = sorted({*hashed(one), *hashed(two)})
        low = [h for h in both if h < LIMIT]
        keep = low if len(low) > FLOOR else both[:FLOOR]
        assert str(merge(sketch(one), sketch(two))) == str(Sketch(np.array(keep, np.uint64), len(keep) == len(both)))


def test_pieces_of_a_long_text(monkeypatch):
    draw = random.Random(2)
    for n in (0, 1, 2, 40, 900):
        text = words(draw, n)
        for part in (1, 5, 64, 1000):
            monkeypatch.setattr(sketches, "PART", part)
            cut = len(text) // 3
            assert str(sketches.long_sketch(bytes_of(text))) == str(sketches.long_sketch(bytes_of(text[:cut]), bytes_of(text[cut:]))) == str(sketch(text))


def test_likeness_and_containment_are_near_the_exact_ones():
    draw = random.Random(3)
    body = [words(draw, 60) for _ in range(150)]
    for text, other in [(body, body[:75] + [words(draw, 4000)]), (body[:20], body), (body, body[:20]), (body[:1], body[:1]), (body[:2], body[5:7])]:
        text, other = " ".join(text), " ".join(other)
        for got, true in zip(compare(sketch(text), sketch(other)), exact(text, other), strict=True):
            assert abs(got - true) < 0.12
    # A short passage of a very long text.
    assert compare(sketch(body[3]), sketch(" ".join(body)))[1] > 0.9
    assert compare(sketch(words(draw, 60)), sketch(" ".join(body)))[1] < 0.05
    assert compare(sketch(""), sketch("")) == (1.0, 1.0)
    assert compare(sketch("a"), sketch("")) == (0.0, 0.0)


def edited(text, following):
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def check(rows, texts):
    """``rows`` against texts in their order, each followed by the next."""
    assert len(rows) == len(texts)
    for r, text, following in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        other = edited(text, following)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        own = sketch(text)
        assert (r.fingerprint, r.edited_fingerprint) == (str(own), str(sketch(other)))
        assert (r.near_edited, r.contained_edited) == compare(own, sketch(other))
        assert (r.near_next, r.contained_next) == compare(own, sketch(following))
        if len(shingles(text) | shingles(other)) <= FLOOR:
            assert (r.near_edited, r.contained_edited) == exact(text, other)


def test_edits_against_brute_force(spark):
    draw = random.Random(11)
    texts = [None, "", "x", *(words(draw, draw.randint(0, 120)) for _ in range(80)), words(draw, 3000), "abc " * 500]
    ids = [*range(-3, len(texts) - 4), 10**12]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fingerprint string, id int").repartition(7)
    got = sketches.with_edits(docs)
    assert got.columns == ["doc_id", *sketches.NAMES]
    rows = sorted(got.collect(), key=lambda r: -r.doc_id)
    assert [r.doc_id for r in rows] == sorted(ids, reverse=True)
    check(rows, [t or "" for _, t in sorted(zip(ids, texts, strict=True), reverse=True)])
    assert {(r.doc_id, r.fingerprint) for r in sketches.fingerprints(docs).collect()} == {(r.doc_id, r.fingerprint) for r in rows}


def test_ids_of_text_nulls_repeated_rows_and_none(spark):
    got = sketches.with_edits(spark.createDataFrame([("b", "second text"), (None, "last of all"), ("ü", "the first one")], "ID string, text string"), doc_id="ID")
    rows = {r.ID: r for r in got.collect()}
    check([rows["ü"], rows["b"], rows[None]], ["the first one", "second text", "last of all"])
    same = spark.range(40).selectExpr("7L as doc_id", "'one and the same text' as text")
    check(sketches.with_edits(same).collect(), ["one and the same text"] * 40)
    assert [r.near_next for r in sketches.with_edits(same.limit(1)).collect()] == [1.0]
    assert sketches.with_edits(same.where("false")).count() == sketches.fingerprints(same.where("false")).count() == 0


def test_long_texts(spark, monkeypatch):
    draw = random.Random(6)
    long = "wörd " * 700_000 + words(draw, 100_000)
    texts = [words(draw, 50), long, words(draw, 20), "", long[: len(long) // 2], long]
    docs = spark.createDataFrame([(10 - k, t) for k, t in enumerate(texts)], "doc_id int, text string").coalesce(1)
    check(sorted(sketches.with_edits(docs).collect(), key=lambda r: -r.doc_id), texts)
    # In one partition, too, where long texts stand beside short ones.
    monkeypatch.setattr(sketches, "partitions", lambda _: 1)
    check(sorted(sketches.with_edits(docs).collect(), key=lambda r: -r.doc_id), texts)


def test_compared(spark):
    one, two = (str(sketch(t)) for t in ("the very same words again", "the very same words, once"))
    pairs = spark.createDataFrame([(one, two, 1), (one, one, 2), (None, one, 3)], "a string, b string, likeness int")
    got = sketches.compared(pairs, "a", "b").collect()
    assert [(r.likeness, r.contained) for r in got] == [compare(parse(one), parse(two)), (1.0, 1.0), (None, None)]
