import random

import numpy as np
import pyarrow as pa
import pytest

from polycat.llm import importance, langid, toxicity
from polycat.llm.arrays import text_bytes

SYLLABLES = {"aa": ["ba", "bo", "lu", "ka"], "bb": ["sch", "ei", "un", "ver"], "cc": ["ção", "que", "é", "os"]}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    rows = [(k, sentence(r, lang, r.randint(3, 60)), lang, "s") for k, lang in enumerate(r.choices(list(SYLLABLES), k=600))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()


def test_codewords_are_apart():
    for n in range(2, 40):
        code = langid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert code.shape[0] == n and min(apart) >= max(1, code.shape[1] // 6)
    assert langid.codewords(4).shape == (4, 7)


def test_bits_can_be_wrong():
    model = langid.Model(list("abcd"), langid.codewords(4), np.eye(7, dtype=np.float32) * 4, np.zeros(7), np.ones(7))
    x = model.code.astype(np.float32)
    for bit in range(7):
        y = x.copy()
        y[:, bit] *= -1
        assert model.decode(y)[0].tolist() == [0, 1, 2, 3]


def test_languages_are_told_apart(spark, corpus):
    model = langid.train(corpus.where("doc_id % 4 <> 2"))
    out = langid.identify(corpus.where("doc_id % 4 = 2"), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    again = langid.train(corpus.where("doc_id % 4 <> 2").repartition(7))
    assert np.allclose(again.weights, model.weights, atol=1e-4)


def test_language_of_odd_rows(spark, corpus):
    model = langid.train(corpus)
    rows = [(1, None, "aa"), (2, "", None), (3, "12 + 4 = ?!", "bb"), (None, "schei unver", "x"), (4, "schei unver", None), (4, "schei unver", None), (5, "verschei " * 300000, "aa"), (6, "é", None)]
    docs = spark.createDataFrame([(d, t, la, 7.0) for d, t, la in rows], "doc_id long, text string, lang string, score double")
    out = langid.identify(docs, model).collect()
    assert len(out) == 8 and out[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score", "ambiguous"}
    assert [(r.lang_pred, r.score) for r in out[:3]] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in out[3:7]] == ["bb"] * 4
    assert langid.identify(docs, model).where(~langid.rejected()).count() >= 4
    assert langid.identify(docs.where("false"), model).count() == 0
    none = langid.train(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    one = langid.train(corpus.where("lang = 'aa'"))
    assert {r.lang_pred for r in langid.identify(corpus, one).collect()} == {"aa"}


def test_every_language_is_learned_and_rare_ones_take_no_rows_from_others(spark, corpus, monkeypatch):
    r = random.Random(7)
    words = {f"x{k}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(4)] for k in range(503)}
    rows = [(10**6 + k, " ".join(w), la) for k, (la, w) in enumerate(words.items())]
    rare = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, labels, languages: learned.append(np.bincount(labels)) or fit(x, labels, languages, rounds=100))
    model = langid.train(corpus.select("doc_id", "text", "lang").unionByName(rare))
    assert set(model.languages) == {"aa", "bb", "cc", *words}
    size = {x["lang"]: x["count"] for x in corpus.groupBy("lang").count().collect()}
    for la, n in size.items():
        assert learned[0][model.languages.index(la)] >= min(n, 400)
    out = langid.identify(rare, model).collect()
    assert np.mean([x.lang_pred == x.lang for x in out]) > 0.95


BAD = ["vile", "nasty", "rotten"]


def toxic_corpus(spark, n=1500):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{r.randint(0, 300)}" for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(BAD).upper() + r.choice(["", "!", ","]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_rows_that_were_held_out(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    assert len(model.feature) < 400
    out = toxicity.score(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    right = [(r.score >= 0.5) == (r.toxic == 1) for r in out]
    assert np.mean(right) > 0.97


def test_toxicity_of_odd_rows(spark):
    docs, labels = toxic_corpus(spark, 400)
    odd = labels.unionByName(spark.createDataFrame([(None, 1), (5000, 1), (3, None), (4, 7)], "doc_id long, toxic int"))
    model = toxicity.train(docs, odd)
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "vile nasty rotten", None), (3, "so vile, " * 200000, "c")], "doc_id long, text string, score string")
    out = toxicity.score(rows, model).collect()
    assert out[0].score == out[1].score and len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    none = toxicity.train(docs, labels.where("false"))
    assert {r.score for r in toxicity.score(rows, none).collect()} == {0.5}
    assert toxicity.score(rows.where("false"), model).count() == 0


def test_ftrl_steps_are_those_of_the_paper():
    """Against a plain version, a coordinate at a time."""
    r = random.Random(5)
    rows = [np.array(sorted(r.sample(range(30), r.randint(1, 8))), np.int32) for _ in range(60)]
    y = np.array([r.randint(0, 1) for _ in rows])
    m = toxicity.fit(rows, y, alpha=0.3, l1=0.4, l2=0.1, epochs=2, seen=1)
    z, n = {}, {}
    alpha, beta, l1, l2 = 0.3, 1.0, 0.4, 0.1

    def weight(i):
        p = 0.0 if i == "bias" else l1
        if abs(z.get(i, 0)) <= p:
            return 0.0
        return -(z[i] - np.sign(z[i]) * p) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(2):
        for row, label in zip(rows, y, strict=True):
            at = [*row.tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in at:
                s = ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / alpha
                z[i] = z.get(i, 0) + g - s * w[i]
                n[i] = n.get(i, 0) + g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert dict(zip(m.feature.tolist(), m.weight.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)
    assert m.bias == pytest.approx(weight("bias"))


def test_importance_weights_and_sample(spark):
    r = random.Random(7)
    good, poor = [f"g{k}" for k in range(50)], [f"p{k}" for k in range(50)]
    rows = [(k, " ".join(r.choice(good if k % 3 else poor) for _ in range(40)), "x") for k in range(900)]
    rows += [(None, "g1 g2", "x"), (901, None, "x"), (902, "", "x"), (903, "g1 " * 300000, "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    targets = spark.createDataFrame([(k,) for k in range(0, 900) if k % 3 and k % 2] + [(None,), (7777,)], "doc_id long")
    out = importance.resample(docs, targets, share=0.6).collect()
    n = len(rows)
    assert len(out) == n and abs(sum(x.kept for x in out) - round(0.6 * n)) <= 1
    kept = [x.doc_id % 3 > 0 for x in out if x.kept and x.doc_id is not None and x.doc_id < 900]
    assert np.mean(kept) > 0.99
    # The weights by brute force.
    text = dict((d, t or "") for d, t, _ in rows)
    count = lambda ts: np.bincount(importance.grams(*text_bytes(pa.array(ts)))[1], minlength=1 << importance.BUCKETS_BITS)
    ratio = importance.log_ratio(count([t or "" for d, t, _ in rows if d is not None and d < 900 and d % 3 and d % 2]), count([t or "" for _, t, _ in rows]))
    for x in out[:40]:
        assert x.log_weight == pytest.approx(float((count([text[x.doc_id]]) * ratio).sum()), abs=1e-6)
    assert importance.resample(docs.where("false"), targets).count() == 0
    assert not any(x.kept for x in importance.resample(docs, targets, share=0.0).collect())
    assert all(x.kept for x in importance.resample(docs, targets.where("false"), share=1.0).collect())


def test_gumbel_sample_follows_the_weights(spark):
    """With two kinds of documents of weights 1 and 3, the first one drawn is of the second kind 3 times in 4."""
    draws = np.random.default_rng(1)
    keys = np.log([1.0, 3.0]) - np.log(-np.log(draws.random((20000, 2))))
    assert abs(keys.argmax(1).mean() - 0.75) < 0.02


def test_kth_largest(spark):
    r = np.random.default_rng(2)
    values = np.concatenate([r.integers(-(1 << 62), 1 << 62, 500), r.integers(-5, 5, 300), [1 << 40] * 50])
    df = spark.createDataFrame([(int(v),) for v in values], "rank long")
    for k in (1, 17, 300, 420, 849, 850):
        assert importance.kth_largest(df, k) == sorted(values.tolist(), reverse=True)[k - 1]
    assert importance.kth_largest(df, 0) is None
