import random

import pytest

import corpus_pipeline
from polycat.llm import langid

from .test_exact_and_lines import brute as line_brute
from .test_minhash import brute as near_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of():
    r = random.Random(12)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"] + [f"v{k}x" for k in range(900)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    boiler = "this very line is found in a great many of the documents here"
    out = []
    for k in range(120):
        text = "\n".join(line(r.randint(8, 20)) for _ in range(r.randint(2, 6)))
        if k % 4 == 0:
            text += "\n" + boiler
        out.append((k, text, "en", f"s{k % 5}"))
    for k in range(120, 150):
        out.append((k, out[k - 120][1] + " tail", "en", None))
    items = [(k, line(40)) for k in range(6)]
    for k in range(150, 156):
        out.append((k, line(60) + " " + items[k - 150][1] + " " + line(60), "en", "s1"))
    out += [(200, None, None, "s1"), (201, "", "en", None), (202, "12 34 !", None, None), (None, "one short text of few words", None, "s9"), (5, out[5][1], "en", "s0"), (5, "another text with this id altogether", "en", "s0")]
    return [(*x, len(x[1]) if x[1] is not None else None) for x in out], items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows, items = rows_of()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage_against_brute_force(spark, folder):
    rows, items = rows_of()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    kept = stages["language_id"](spark, docs, folder).cache()
    lettered = [(d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t)]
    assert kept.columns == docs.columns and pairs(kept) == sorted(lettered, key=str)

    lines = stages["line_dedup"](spark, kept, folder).cache()
    want = line_brute(lettered, 40, 5)
    assert lines.columns == docs.columns and pairs(lines) == sorted(((d, want[d, t][2]) for d, t in lettered), key=str)
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = stages["near_dedup"](spark, lines, folder).cache()
    left = [(d, want[d, t][2]) for d, t in lettered]
    groups = {c for _, n, c in near_brute(left, 80) if n}
    got = pairs(near)
    assert near.columns == docs.columns and set(got) <= set(left)
    # Id 5 has a second text, a group of its own; all texts here have words.
    assert len(got) == len(groups) + 1 and (5, "another text with this id altogether") in got
    assert all(str(d) == c for d, _, c in near_brute(got, 80))

    clean = stages["decontaminate"](spark, near, folder).cache()
    assert clean.columns == docs.columns
    assert {d for d, _ in got} - {r.doc_id for r in clean.collect()} == set(range(150, 156))

    mixed = stages["mix_sources"](spark, clean, folder).collect()
    assert sorted(r.mix_position for r in mixed) == list(range(clean.count()))


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out.count() > 100


def test_an_empty_table_goes_through(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rejection_is_a_documented_rule(spark):
    df = spark.createDataFrame([("und", 0.0), ("en", 0.39), ("en", 0.41)], "lang_pred string, score double")
    assert df.where(~langid.rejected()).count() == 1


def test_decontaminate_draws_no_documents_for_its_space(spark, tmp_path, monkeypatch):
    """Word weights come from all documents, the latent space from all documents and all items."""
    from polycat.llm import leaks

    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('w', id % 700, ' v', id % 90) AS text")
    spark.createDataFrame([(k, f"item {k} of these") for k in range(7)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name in ("inverse_frequencies", "latent_space"):
        plain = getattr(leaks, name)
        monkeypatch.setattr(leaks, name, lambda texts, *a, name=name, plain=plain, **k: seen.setdefault(name, texts.count()) and plain(texts, *a, **k))
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == 5000
    assert seen == {"inverse_frequencies": 5000, "latent_space": 5007}
