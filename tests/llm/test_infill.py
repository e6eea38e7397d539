import hashlib
import random
import re

import pyarrow as pa
import pytest

from polycat.llm import arrays, infill

WORDS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text, rate=50, spm=80, seed="42"):
    """n, form, characters of prefix and middle, output: by the contract's words, with Python's strings."""
    text = text or ""
    tokens = WORDS.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < spm:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    draw = random.Random(5)
    odd = [None, "", " ", "\n\n", "a", "  a  b \n", "x <P> y", "<S>", "<M", "a <S b >M> <P", "é \u0085 ü z\x0bq", "nul \x00 here", "x\x1cy", "日本 語\r\n" * 30]
    return odd + ["".join(draw.choice("ab <>SPM\n\té") for _ in range(draw.randint(0, 60))) for _ in range(700)]


def rows_of(made):
    return [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made]


def test_equals_brute_force(spark):
    given = [(k, t, 1) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(given, "doc_id long, text string, output int").repartition(5)
    made = infill.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(made.collect(), key=lambda r: r.doc_id)
    assert rows_of(got) == [brute(k, t) for k, t, _ in given]
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert {(r.doc_id, r.text) for r in infill.restore(made).collect()} == {(k, t or "") for k, t, _ in given}
    for r in infill.digests(made).collect():
        assert r.output_sha256 == hashlib.sha256(got[r.doc_id].output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((given[r.doc_id][1] or "").encode()).hexdigest()


@pytest.mark.parametrize(("rate", "spm"), [(0, 80), (100, 0), (100, 100)])
def test_rates_seeds_marks_and_ids_of_text(spark, rate, spm):
    docs = spark.createDataFrame([("k", "one two three four"), (None, "five six"), (None, "five six"), ("ü", "a [PRE] b")], "ID string, text string")
    got = infill.fill_in_middle(docs, doc_id="ID", rate=rate, spm=spm, seed="s").collect()
    assert sorted(map(str, rows_of(got))) == sorted(str(brute(r.ID, r.text, rate, spm, "s")) for r in docs.collect())
    marks = ("[PRE]", "[SUF]", "[MID]")
    other = infill.fill_in_middle(docs, doc_id="ID", rate=rate, spm=spm, marks=marks)
    assert [r.form for r in other.where("ID = 'ü'").collect()] == ["plain"]
    assert sorted(r.text for r in infill.restore(other, marks=marks).collect()) == ["a [PRE] b", "five six", "five six", "one two three four"]


def test_no_rows(spark):
    made = infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert made.count() == infill.digests(made).count() == infill.restore(made).count() == 0


def test_pieces_change_nothing(monkeypatch):
    """With pieces of a few bytes every text is cut into many, at ends of tokens only."""
    monkeypatch.setattr(infill, "is_long", lambda offsets: len(offsets) == 2 and offsets[1] > 7)
    monkeypatch.setattr(infill, "steps", lambda offsets, rows: arrays.steps(offsets, 1, rows))
    monkeypatch.setattr(infill.token_ends, "__defaults__", (7,))
    given = texts()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(given))), pa.array([str(k) for k in range(len(given))]), pa.array(given)], names=["id", "shown", "text"])
    made = pa.Table.from_batches(infill._formatter(infill.MARKS, "42", 50, 80)(iter([batch]))).to_pylist()
    assert [tuple(m[c] for c in infill.TABLE.names) for m in made] == [brute(k, t) for k, t in enumerate(given)]


def test_one_long_text(spark):
    text = "wörd  two\n" * 900_000 + "x" * 5_000_000 + " end "
    got = infill.fill_in_middle(spark.createDataFrame([(3, text)], "doc_id long, text string"), rate=100)
    (row,) = got.collect()
    assert rows_of([row]) == [brute(3, text, 100)]
    assert infill.restore(got).first().text == text
