"""Texts that are worked on in pieces give what they give whole; ids and bytes of any kind; bounds of samples."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polycat.llm import arrays, filters, fingerprints, importance, langid, lines, minhash, tokens, toxicity
from polycat.llm.queries import TOKENIZER, tokenizer_path

WORDS = ["a", "Bc", "déjà", "x" * 30, "12", "!?", "\n", "\t ", "　", "long", "longer", "don't"]
texts = st.lists(st.sampled_from(WORDS), max_size=60).map(" ".join)


def both(monkeypatch, text, call):
    """What a call says of one text, whole and in pieces of some bytes."""
    data, offsets = arrays.text_bytes(pa.array([text]))
    with monkeypatch.context() as m:
        for module in (arrays, fingerprints, langid, lines, tokens):
            m.setattr(module, "LONG_BYTES", 1 << 40)
        m.setattr(arrays, "is_long", lambda o: False)
        whole = call(data, offsets)
    out = []
    for size in (1, 7, 40):
        with monkeypatch.context() as m:
            for module in (arrays, fingerprints, langid, lines, tokens):
                m.setattr(module, "LONG_BYTES", size)
            m.setattr(lines, "STEP_BYTES", 5)
            m.setattr(minhash, "MOST_VALUES", 3)
            out.append(call(data, offsets))
    return whole, out


@settings(max_examples=60, deadline=None)
@given(texts)
def test_in_pieces_as_whole(text):
    m = pytest.MonkeyPatch()
    if not text:
        return

    def shingled(data, offsets):
        values, first = minhash.shingles(data, offsets, 5)
        return values.tolist(), minhash.minima(values, first, 6).tolist(), minhash._digest(values, first)

    def counted(data, offsets):
        total = np.zeros(1 << importance.BUCKETS_BITS, np.int64)
        for _, bucket in importance.gram_steps(data, offsets):
            total += np.bincount(bucket, minlength=len(total))
        return np.flatnonzero(total).tolist(), total[total > 0].tolist()

    def toxic(data, offsets):
        return np.unique(toxicity.features(data, offsets)[1]).tolist()

    def grams(data, offsets):
        return np.round(langid.features(data, offsets, 256), 5).tolist(), langid._lettered(data, offsets).tolist()

    def printed(data, offsets):
        one, two, n, sha, whole = fingerprints.hashed(data, offsets, fingerprints.POINTS, fingerprints.MODULUS)
        return one.tolist(), two.tolist(), n.tolist(), sha or [hashlib.sha256(whole[0]).hexdigest()]

    def keyed(data, offsets):
        found = [(p, d) for _, _, row, position, digest in lines._line_steps(data, offsets, 3) for p, d in zip(position.tolist(), digest, strict=True)]
        return sorted(found)

    for call in (shingled, counted, toxic, grams, printed, keyed):
        whole, parts = both(m, text, call)
        assert all(p == whole for p in parts), call.__name__


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.compiled(tokenizer_path(TOKENIZER))


@settings(max_examples=40, deadline=None)
@given(texts)
def test_tokens_in_parts(tokenizer, text):
    if text:
        whole, parts = both(pytest.MonkeyPatch(), text + "<|endoftext|> end", lambda data, offsets: tokenizer.count(data, offsets).tolist())
        assert all(p == whole for p in parts)


def test_one_long_text_through_all_operators(spark, tokenizer):
    r = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    text = "\n".join(" ".join(r.choices(words, k=12)) for _ in range(180_000))  # some 12 MB: several pieces
    line = "one line that is found in five documents and is long enough"
    rows = [(1, text), (2, text.replace(" ", "  ")), (3, text + " x"), (9, text + "\n" + line), *((k, line) for k in range(4, 9)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {x.doc_id: x for x in fingerprints.exact_duplicates(docs).collect()}
    assert (kept[1].group_size, kept[2].keep_id, kept[3].kept, kept[4].group_size) == (2, 1, True, 5)
    assert kept[1].text_sha256 == hashlib.sha256(" ".join(text.split()).encode()).hexdigest()
    near = {x.doc_id: x for x in minhash.near_duplicates(docs).collect()}
    assert [near[k].component_id for k in (1, 2, 3, 9)] == [1] * 4
    marks = lines.shared_lines(docs)
    got = {x.doc_id: x for x in lines.apply_bitmaps(docs, marks).collect()}
    assert got[9].text == text + "\n" + line and got[9]._n_dropped == 0 and all(got[k]._n_dropped == 1 and got[k].text == "" for k in range(4, 9))
    assert got[1]._n_lines == 180_000 and got[None].text is None
    n = {x.doc_id: x.n_bytes for x in tokens.token_counts(docs, tokenizer).where("n_tokens > 0").collect()}
    assert n[1] == len(text)


def test_string_ids(spark):
    line = "a line of forty code points or some more of them"
    body = " ".join(f"w{k}" for k in range(40))
    rows = [(f"id-{k}", f"{line}\nown {k}") for k in range(7)] + [(None, line), ("x", body), ("y", body + " z"), ("x", body)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    out = lines.apply_bitmaps(docs, lines.shared_lines(docs)).collect()
    assert sorted((str(r.doc_id), r._n_dropped) for r in out) == sorted([(f"id-{k}", int(k < 6)) for k in range(7)] + [("None", 1), ("x", 0), ("x", 0), ("y", 0)])
    left = minhash.drop_near_duplicates(docs)
    assert left.where("doc_id in ('x', 'y')").count() == 1
    # By brute force: id-0 to id-6 share 8 of 10 shingles (0.8, just linked), the line alone 7 of 9.
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    assert left.count() == len(set(group)) == 3
    kept = {(r.doc_id, r.keep_id) for r in fingerprints.exact_duplicates(docs).collect()}
    assert ("x", "x") in kept and ("y", "y") in kept


def test_bytes_that_are_not_utf8(spark, tokenizer):
    docs = spark.sql("select 1L as doc_id, cast(x'61ff2062' as string) as text, 2 as N_TOKENS union all select 2L, 'a b', 3")
    out = {r.doc_id: r for r in tokens.token_counts(docs, tokenizer).collect()}
    (want,) = tokenizer.count(*arrays.text_bytes(pa.array(["a� b"]))).tolist()
    assert (out[1].n_bytes, out[1].n_tokens) == (4, want) and out[1].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}


def test_filters_grow_with_their_rows(spark):
    ids = spark.range(5000)
    words = filters.row_filter(ids)
    assert 64 * len(words) == filters.LEAST_BITS
    h = np.array([r[0] for r in spark.range(20000).selectExpr("xxhash64(id)").collect()])
    hit = filters.passes(words, h)
    assert hit[:5000].all() and hit[5000:].mean() < 0.01
    big = filters.bit_filter(ids.selectExpr("xxhash64(id) as a", "xxhash64(id, 1) as b"), 200_000)
    assert 64 * len(big) == 1 << 22


def test_samples_keep_their_bounds_where_one_id_has_most_rows(spark):
    same = [(None, "un deux trois " * 3, "fr")] * 3000
    docs = spark.createDataFrame(same + [(k, f"one two three {k}", "en") for k in range(100)], "doc_id long, text string, lang string")
    learned = []
    m = pytest.MonkeyPatch()
    with m.context() as p:
        fit = langid.fit
        p.setattr(langid, "fit", lambda x, labels, languages: learned.append(np.bincount(labels)) or fit(x, labels, languages, rounds=5))
        langid.train(docs, each=50)
    assert max(learned[0]) <= 50
    keyed = spark.createDataFrame([(1, f"text {k} of one id", 1) for k in range(2000)], "doc_id long, text string, toxic int")
    seen = []
    with m.context() as p:
        p.setattr(toxicity.Workspace, "save", lambda self, df, name, save=toxicity.Workspace.save: seen.append(name) or save(self, df, name))
        model = toxicity.train(keyed.select("doc_id", "text"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), sample=100)
    assert seen == ["drawn"] and model.bias > 0


def test_language_features_and_fit_are_those_of_plain_versions():
    text = "Ab, c"
    data, offsets = arrays.text_bytes(pa.array([text, ""]))
    folded = [langid.FOLD[b] for b in text.encode()]
    want = np.zeros(64)
    for n in langid.ORDERS:
        for k in range(len(folded) - n + 1):
            h = 0
            for j, b in enumerate(folded[k : k + n]):
                h = ((h * 0x01000193 if j else 0) + int(b) + 1) & 0xFFFFFFFF
            want[((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - 6)] += 1
    got = langid.features(data, offsets, 64)
    assert np.allclose(got[0], np.sqrt(want / want.sum()), atol=1e-6) and not got[1].any()
    # Loss-weighted decoding, a word at a time.
    rng = np.random.default_rng(0)
    model = langid.Model(list("abcde"), langid.codewords(5), rng.normal(size=(8, 15)).astype(np.float32), rng.normal(size=15), rng.uniform(0.1, 1, 15).astype(np.float32))
    x = rng.normal(size=(20, 8)).astype(np.float32)
    best, p = model.decode(x)
    for row, k, q in zip(x, best.tolist(), p, strict=True):
        margin = row @ model.weights + model.bias
        loss = [sum(t * np.log1p(np.exp(-m * c)) for t, m, c in zip(model.trust, margin, code, strict=True)) for code in model.code.astype(float)]
        assert k == int(np.argmin(loss))
        assert np.allclose(q, np.exp(min(loss) - np.array(loss)) / np.exp(min(loss) - np.array(loss)).sum(), atol=1e-4)
    # Gradient steps lead to where plain descent on the same loss does.
    sample = np.abs(rng.normal(size=(60, 6))).astype(np.float32)
    labels = rng.integers(0, 2, 60)
    fitted = langid.fit(sample, labels, ["a", "b"], rounds=4000, rate=1.0, decay=0.05)
    y = langid.codewords(2)[labels].astype(float)[:, 0]
    weight = (1 / np.bincount(labels))[labels]
    weight /= weight.sum()
    w, b = np.zeros(6), 0.0
    for _ in range(20000):
        pull = weight * y / (1 + np.exp(y * (sample @ w + b)))
        w, b = w + 0.5 * (sample.T @ pull - 0.05 * w), b + 0.5 * pull.sum()
    assert np.allclose(fitted.weights[:, 0], w, atol=1e-2) and abs(fitted.bias[0] - b) < 1e-2


def test_importance_weights_and_ties(spark):
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(r.choices(vocab[:40] if k % 3 else vocab[20:], k=r.randint(1, 30)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = docs.where("doc_id % 3 = 0").select("doc_id")
    out = importance.resample(docs, good, share=0.3).collect()
    assert sum(x.kept for x in out) == 60
    keys = sorted((x.gumbel_key for x in out), reverse=True)
    assert all(x.kept == (x.gumbel_key >= keys[59]) for x in out)

    def counts(some):
        total = {}
        for t in some:
            w = t.split()
            for g in [*w, *zip(w, w[1:], strict=False)]:
                h = arrays.Words(*arrays.text_bytes(pa.array([" ".join(g) if isinstance(g, tuple) else g])), arrays.MARKS)
                hashes = h.hashes(arrays.text_bytes(pa.array([" ".join(g) if isinstance(g, tuple) else g]))[0])
                v = hashes[0] if len(hashes) == 1 else arrays.mix(hashes[:1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:], 5)[0]
                b = int(v >> np.uint64(64 - importance.BUCKETS_BITS))
                total[b] = total.get(b, 0) + 1
        return total

    raw, target = counts(t for _, t in rows), counts(t for k, t in rows if k % 3 == 0)
    size = 1 << importance.BUCKETS_BITS
    log_p = lambda c, b: np.log((c.get(b, 0) + 1) / (sum(c.values()) + size))
    texts_of = dict(rows)
    for x in out[:20]:
        want = sum(n * (log_p(target, b) - log_p(raw, b)) for b, n in counts([texts_of[x.doc_id]]).items())
        assert abs(x.log_weight - want) < 1e-6
    # Keys are weights plus Gumbel noise: over many seeds each row's noise has its mean and spread.
    noise = np.array([x.gumbel_key - x.log_weight for seed in range(6) for x in importance.resample(docs, good, seed=seed).collect()])
    assert abs(noise.mean() - 0.5772) < 0.15 and abs(noise.var() - np.pi**2 / 6) < 0.4
    same = spark.createDataFrame([(7, "a b")] * 50 + [(8, "c")], "doc_id long, text string").repartition(3)
    for share in (0.2, 0.5, 1.0):
        assert importance.resample(same, good, share=share).where("kept").count() == round(51 * share)


def test_hot_keys_are_split_and_sets_that_share_nothing_rare_are_not_compared(spark, monkeypatch):
    r = random.Random(5)
    # Templates: 70 % of the words are shared, the rest is each one's own.
    shared = [f"t{k}" for k in range(70)]
    rows = [(k, " ".join(shared + [f"o{k}-{j}" for j in range(30)])) for k in range(400)]
    compared = []
    across = minhash._across
    monkeypatch.setattr(minhash, "_across", lambda placed, *more: compared.append(placed.count()) or across(placed, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(docs, percent=80, bands=64, rows=1).collect()  # so few rows that all share a bucket
    assert all(x.kept for x in out) and compared == [0]
    # The same with links among them: found.
    rows += [(1000 + k, rows[k][1] + f" {r.random()}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs, percent=80, bands=64, rows=1).collect()}
    assert all(got[1000 + k] == k for k in range(20)) and all(got[k] == k for k in range(400))


def test_bitmaps_of_whole_lines():
    for text in ("a\nb\n\nc", "", "\n", "x\n" * 5, "é\nü"):
        parts = text.split("\n")
        for seed in range(5):
            r = random.Random(seed)
            keep = [r.random() < 0.5 for _ in parts]
            bits = zlib.compress(np.packbits(np.array(keep, np.uint8)).tobytes())
            data = np.frombuffer(text.encode(), np.uint8)
            assert lines.kept_text(data, bits).decode() == "\n".join(p for p, k in zip(parts, keep, strict=True) if k)
