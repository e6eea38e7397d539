import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from polycat.llm import leaks


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=90), st.lists(st.integers(0, 5), max_size=40))
def test_common_subsequence(a, b):
    assert leaks.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == plain_lcs(a, b)


def test_latent_space_holds_most_of_what_the_best_one_would(spark):
    r = random.Random(2)
    topics = [[f"t{t}w{k}" for k in range(30)] for t in range(10)]
    rows = [(" ".join(r.choice(topics[k % 10]) for _ in range(64)),) for k in range(300)]
    texts = spark.createDataFrame(rows, "text string")
    idf = leaks.inverse_frequencies(texts)
    v = leaks.latent_space(texts, idf, rank=12)
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-3)
    import pyarrow as pa

    words, h = leaks.hashed_words(*leaks.lowered(pa.array([t for (t,) in rows])))
    dense = []
    for first, f, w in leaks._passages(words, h, idf, leaks.PASSAGE):
        m = np.zeros((len(first), len(idf)))
        np.add.at(m, (np.repeat(np.arange(len(first)), np.diff(np.append(first, len(f)))), f), w)
        dense.append(m)
    a = np.concatenate(dense)
    best = (np.linalg.svd(a[:, a.any(0)], compute_uv=False)[:12] ** 2).sum()
    assert ((a @ v) ** 2).sum() > 0.9 * best


def corpus():
    r = random.Random(8)
    zipf = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 2) for k in range(3000)]
    some = lambda n: r.choices(zipf, weights, k=n)
    items = [some(n) for n in [15, 20, 30, 38, 45, 59, 70, 9] * 4]
    docs, want = [], set()
    for k in range(500):
        text = some(r.randint(20, 400))
        if k < 120:
            item = k % len(items)
            passage = list(items[item])
            if k >= 60:  # a paraphrase: every fifth word replaced, its answer left alone
                passage = [r.choice(zipf) if j % 5 == 2 and j < 2 * len(passage) // 3 else w for j, w in enumerate(passage)]
            at = r.randrange(len(text))
            text[at:at] = passage
            want.add((k, item))
        docs.append((k, " ".join(w.upper() + "," if k % 7 == 0 else w for w in text)))
    return docs, [(k, " ".join(t)) for k, t in enumerate(items)], want


def test_leaks_are_found_and_nothing_else(spark):
    docs, items, want = corpus()
    bench = spark.createDataFrame([(k, t, "z") for k, t in items] + [(900, None, "z"), (901, "", "z"), (902, "?!", "z")], "item_id long, text string, leaks string")
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, leaks string")
    out = leaks.find_leaks(df, bench).collect()
    assert len(out) == len(docs) and out[0].asDict().keys() == {"doc_id", "text", "leaks"}
    got = {(r.doc_id, x.item_id) for r in out for x in r.leaks}
    exact = {(d, i) for d, i in want if d < 60}
    assert exact <= got
    assert len(want & got) >= 0.95 * len(want)
    # Brute force over all documents and some items: what meets the rule in the near reach is found, and nothing is that doesn't in the far one.
    for k, text in items[:3]:
        item = text.split()
        for d, t in docs:
            words = t.replace(",", "").lower().split()
            if (Counter(item) & Counter(words)).total() < 0.55 * len(item):  # the rule needs that many
                assert (d, k) not in got
                continue
            assert not leaked(item, words, leaks._half(len(item)), lcs=fast_lcs) or (d, k) in got
            assert (d, k) not in got or leaked(item, words, len(item), lcs=fast_lcs)
    assert len(got - want) == 0
    for r in out:
        for x in r.leaks:
            assert x.share >= 0.55 and -1 <= x.cosine <= 1.001


def test_odd_rows_and_blocks(spark, monkeypatch):
    docs, items, want = corpus()
    rows = [(None, items[3][1]), (1, None), (2, ""), (3, items[0][1]), (3, items[0][1]), (4, ("x y " * 5 + items[4][1] + " ") * 300), (5, "w1 " * 50000)]
    df = spark.createDataFrame(rows + docs[200:260], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    shown = lambda d: sorted((str(r.doc_id), len(r.text or ""), sorted(x.item_id for x in r.leaks)) for r in d.collect())
    one = shown(leaks.find_leaks(df, bench))
    assert {x[0]: x[2] for x in one if x[0] in ("None", "1", "2", "3", "4", "5")} == {"None": [3], "1": [], "2": [], "3": [0], "4": [4], "5": []}
    assert len([x for x in one if x[0] == "3"]) == 2
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 2000)
    assert shown(leaks.find_leaks(df, bench)) == one
    monkeypatch.setattr(leaks, "MOST_CELLS", 0)
    assert shown(leaks.find_leaks(df, bench)) == one
    assert leaks.find_leaks(df.where("false"), bench).count() == 0
    assert all(not r.leaks for r in leaks.find_leaks(df, bench.where("false")).collect())


def test_an_answer_of_its_own(spark):
    base = [f"q{k}" for k in range(30)]
    half = [w if k % 3 else f"other{k}" for k, w in enumerate(base)]
    bench = spark.createDataFrame([(1, " ".join(base), "forty two exactly")], "item_id long, text string, answer string")
    filler = [(k, " ".join(f"f{(k * 7 + j) % 400}" for j in range(60))) for k in range(10, 60)]
    docs = spark.createDataFrame([(1, " ".join(half) + " forty two exactly"), (2, " ".join(half) + " something else here"), *filler], "doc_id long, text string")
    got = {r.doc_id for r in leaks.find_leaks(docs, bench, answer="answer").where("size(leaks) > 0").collect()}
    assert got == {1}


def fast_lcs(a, b):
    """The operator's own, which is tested above against the plain one."""
    at = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    return leaks.common_subsequence(*(np.array([at[w] for w in x], np.uint64) for x in (a, b)))


def leaked(item, doc, reach, most=0.75, part=0.55, answered=0.8, lcs=plain_lcs):
    """Brute force: whether any window of a text, with ``reach`` words on either side, meets the rule."""
    size = max([s for s in leaks.SIZES if s <= len(item)], default=leaks.SIZES[0])
    answer = item[len(item) - -(-len(item) // 3) :]
    last = max(len(doc) - size, 0)
    for begin in {*range(0, last, max(1, size // 4)), last}:
        near = doc[max(begin - reach, 0) : begin + size + reach]
        share = lcs(item, near) / len(item)
        if share >= most or share >= part and lcs(answer, near) >= answered * len(answer):
            return True
    return False


def test_paraphrases_in_words_of_their_own_are_found_as_brute_force_does(spark):
    r = random.Random(4)
    common, rare = [f"w{k}" for k in range(400)], [f"r{k}" for k in range(20000)]
    weights = [1 / (k + 2) for k in range(400)]
    items = [r.choices(common, weights, k=n) for n in (15, 22, 38, 59) * 2]
    docs = []
    for k in range(96):
        text = r.choices(common, weights, k=r.randint(0, 60)) + r.choices(rare, k=r.randint(0, 60))
        passage = list(items[k % len(items)])
        # The share of words replaced; the answer is left alone in half of them.
        free = len(passage) - (-(-len(passage) // 3) if k % 2 else 0)
        for j in r.sample(range(free), min(free, round((0.25 + 0.2 * (k // 8) / 11) * len(passage)))):
            passage[j] = r.choice(rare)
        at = r.randint(0, len(text))
        docs.append(text[:at] + passage + text[at:])
    want, most = ({(d, i) for d, text in enumerate(docs) for i, item in enumerate(items) if leaked(item, text, reach(len(item)))} for reach in (leaks._half, int))
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    out = leaks.find_leaks(df, spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    got = {(x.doc_id, y.item_id): y.cosine for x in out.collect() for y in x.leaks}
    assert want <= got.keys() <= most
    assert all(got[x] >= 0.55 for x in got.keys() - want)
    assert len(want) > 40


def test_latent_space_has_the_items_of_all_blocks(spark, monkeypatch):
    docs, items, _ = corpus()
    df = spark.createDataFrame(docs[:20] + docs[200:220], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    shown = lambda: sorted((r.doc_id, x.item_id, x.cosine) for r in leaks.find_leaks(df, bench, sample=0).collect() for x in r.leaks)
    one = shown()
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 2000)
    more = shown()
    assert [x[:2] for x in more] == [x[:2] for x in one] and len(one) >= 20
    assert np.allclose([x[2] for x in more], [x[2] for x in one], atol=1e-3)


def test_ids_of_any_type_bad_bytes_and_several_passes(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs, items, _ = corpus()
    bench = spark.createDataFrame([(f"item-{k}", t) for k, t in items], "item_id string, text string")
    df = spark.createDataFrame([(f"doc {d}", t) for d, t in docs[:40]], "doc_id string, text string")
    # A byte that isn't UTF-8 between words.
    odd = df.withColumn("text", F.concat(F.decode(F.lit(b"x"), "UTF-8"), F.lit(" "), F.col("text"))).withColumn("text", F.expr("concat(cast(x'ff20' as string), text)"))
    shown = lambda: sorted((r.doc_id, x.item_id) for r in leaks.find_leaks(odd, bench).collect() for x in r.leaks)
    one = shown()
    assert {(f"doc {k}", f"item-{k % len(items)}") for k in range(40)} <= set(one)
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(leaks, "BLOCKS_A_PASS", 2)
    assert shown() == one


def test_recall_by_kind_of_synonym(spark):
    """Words replaced by common or rare ones, each fifth or each third of the first two thirds: leaks by the rule are found."""
    r = random.Random(11)
    common, rare = [f"w{k}" for k in range(600)], [f"r{k}" for k in range(20000)]
    weights = [1 / (k + 2) for k in range(600)]
    items = [r.choices(common, weights, k=n) for n in (12, 20, 31, 45, 58, 70)]
    docs, want = [], []
    for k in range(96):
        item, step, pool = k % 6, (5, 3)[k // 6 % 2], (common, rare)[k // 12 % 2]
        passage = list(items[item])
        for j in range(step - 1, 2 * len(passage) // 3, step):
            passage[j] = r.choice(pool)
        text = r.choices(common, weights, k=r.randint(0, 80)) + r.choices(rare, k=r.randint(0, 80))
        at = r.randint(0, len(text))
        docs.append((k, " ".join(text[:at] + passage + text[at:])))
        if leaked(items[item], text[:at] + passage + text[at:], leaks._half(len(items[item])), lcs=fast_lcs):
            want.append((step, pool is rare, k, item))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x.doc_id, y.item_id) for x in leaks.find_leaks(df, spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")).collect() for y in x.leaks}
    for kind in {w[:2] for w in want}:
        mine = [w[2:] for w in want if w[:2] == kind]
        assert sum(w in got for w in mine) >= 0.95 * len(mine), kind
    assert len({w[:2] for w in want}) == 4


def synonyms():
    """A corpus in which two words stand for each meaning, in the same places; items in the first words, paraphrases that put in the second."""
    r = random.Random(3)
    meanings = [[f"m{t}x{k}" for k in range(40)] for t in range(12)]
    say = lambda word: word + ("a" if r.random() < 0.5 else "b")
    docs = [(k, " ".join(say(r.choice(meanings[k % 12])) for _ in range(120))) for k in range(600)]
    items, want = [], []
    for k in range(24):
        items.append((k, [r.choice(meanings[k % 12]) + "a" for _ in range(36)]))
    for k in range(96):
        item = items[k % 24][1]
        # Most of what comes before the answer in other words, the answer (its last third) as it is.
        other = [w[:-1] + "b" if j < 24 and (j % 3 or j % 8 == 0) else w for j, w in enumerate(item)]
        text = [say(r.choice(meanings[(k + 5) % 12])) for _ in range(40)]
        docs.append((1000 + k, " ".join(text[:20] + other + text[20:])))
        want.append((1000 + k, k % 24))
    return docs, [(k, " ".join(t)) for k, t in items], want


def test_paraphrases_are_lost_without_the_latent_space(spark):
    docs, items, want = synonyms()
    share = [fast_lcs(dict(items)[i].split(), dict(docs)[d].split()) / 36 for d, i in want]
    assert 0.4 <= min(share) and max(share) < 0.55  # too little for the rule without the latent space
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda **given: {(r.doc_id, x.item_id) for r in leaks.find_leaks(df, bench, **given).collect() for x in r.leaks}
    got = found()
    assert len(got & set(want)) >= 0.95 * len(want)
    assert all(d >= 1000 for d, _ in got)  # no document that only shares the subject
    assert not found(near=2.0) & set(want)


def test_long_texts_are_searched_in_pieces(monkeypatch):
    """Leaks over the cuts, too: the same items, at the same places, as in one piece."""
    import pyarrow as pa

    docs, items, _ = corpus()
    idf = np.ones(1 << leaks.BITS, np.float32)
    space = np.random.default_rng(0).standard_normal((1 << leaks.BITS, 8)).astype(np.float32)
    block = leaks.Retriever(idf, space, leaks._items([(k, t, None) for k, t in items[:12]] + [(3, items[3][1], None)], idf, space), 0.55, 0.75, 0.55, 0.8, 0.85, 0.4)
    text = " ".join(t for _, t in docs[:60])
    data, offsets = leaks.lowered(pa.array([text]))
    (want,) = block.leaks(data, offsets)
    assert sorted(x[0] for x in want) == sorted([*range(12), 3])
    for size in (300, 1000, 7000):
        monkeypatch.setattr(leaks.arrays, "LONG_BYTES", size)
        got = leaks.long_leaks(block, data)
        assert sorted(x[0] for x in got) == sorted(x[0] for x in want)
        words = text.replace(",", "").lower().split()
        for item, _, share, start in got:  # an item that stands there more than once may be found at another place
            near = words[max(0, start - 80) : start + 160]
            assert share == 1.0 and fast_lcs(items[item][1].split(), near) == len(items[item][1].split())
    assert leaks.long_leaks(block, data[:0]) == []


def test_latent_space_is_spanned_by_all_documents(spark):
    docs, items, _ = synonyms()
    r = random.Random(7)
    docs += [(2000 + k, " ".join(f"n{k % 90}x{r.randrange(60)}" for _ in range(40))) for k in range(4000)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    shown = lambda **given: sorted((x.doc_id, y.item_id, y.cosine) for x in leaks.find_leaks(df, bench, **given).collect() for y in x.leaks)
    got, want = shown(), shown(sample=1 << 30)
    assert len(got) >= 90 and [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-3)


def test_latent_space_is_the_same_however_texts_are_dealt(spark):
    """The sums of one task and of many; passages of every length; against the two products in full."""
    import pyarrow as pa

    r = random.Random(5)
    rows = [" ".join(f"t{k % 6}w{r.randrange(40)}" for _ in range(k % 101)) for k in range(400)]
    texts = spark.createDataFrame([(t,) for t in rows], "text string")
    idf = leaks.inverse_frequencies(texts)
    words, h = leaks.hashed_words(*leaks.lowered(pa.array(rows)))
    df = np.bincount([f for k in range(len(rows)) for f in set(leaks.feature_of(h[words.first[k] : words.first[k + 1]]).tolist())], minlength=len(idf))
    assert np.allclose(idf, np.log((2 + len(rows)) / (1 + df)), atol=1e-5)
    start = np.random.default_rng(3).standard_normal((len(idf), 9)).astype(np.float32)
    whole = np.zeros((len(idf), 9))
    for first, f, w in leaks._passages(words, h, idf, leaks.PASSAGE):
        for a, b in zip(first, [*first[1:], len(f)], strict=True):
            np.add.at(whole, f[a:b], w[a:b, None] * (w[a:b] @ start[f[a:b]]))
    q, _ = np.linalg.qr(whole)
    for parts in (1, 13):
        v = leaks.latent_space(texts.repartition(parts), idf, rank=9)
        assert np.allclose(v.T @ v, np.eye(9), atol=1e-4) and np.allclose(q @ (q.T @ v), v, atol=1e-3)


def block_of(items):
    idf = np.ones(1 << leaks.BITS, np.float32)
    space = np.random.default_rng(0).standard_normal((1 << leaks.BITS, 8)).astype(np.float32)
    return leaks.Retriever(idf, space, leaks._items([(k, t, None) for k, t in enumerate(items)], idf, space), 0.55, 0.75, 0.55, 0.8, 0.85, 0.4)


def test_texts_with_few_different_words_of_an_item_are_not_aligned(monkeypatch):
    """However often they have these; texts that have the item are aligned and found as before."""
    import pyarrow as pa

    items = [" ".join(f"i{k}w{j}" for j in range(30)) for k in range(4)]
    texts = [" ".join(f"i{k % 4}w{j % 9} x{j % 5}" for j in range(400)) for k in range(40)]
    texts[7] += " " + items[2]
    calls = []
    plain = leaks.common_subsequence
    monkeypatch.setattr(leaks, "common_subsequence", lambda a, b: calls.append(1) or plain(a, b))
    got = block_of(items).leaks(*leaks.lowered(pa.array(texts)))
    assert [(k, x[0], x[2]) for k, mine in enumerate(got) for x in mine] == [(7, 2, 1.0)]
    assert len(calls) <= 2


def test_words_in_common_are_counted_as_often_as_both_have_them(monkeypatch):
    r = random.Random(6)
    items = [[r.randrange(12) for _ in range(r.randint(3, 20))] for _ in range(9)]
    text = [r.randrange(15) for _ in range(300)]
    # Hashes that share their leading bits, so that some words are looked for one after the other.
    h = lambda words: np.array([(w % 3 << 60) + w * 5 for w in words], np.uint64)
    for cells in (leaks.MOST_CELLS, 0):
        monkeypatch.setattr(leaks, "MOST_CELLS", cells)
        block = leaks.Items(list(range(9)), [h(x) for x in items], [0] * 9, np.zeros((9, 2), np.float32), np.full(9, 4))
        number = block.numbers(h(text))
        assert [None if n < 0 else int(block.vocabulary[n]) for n in number.tolist()] == [int(x) if x in block.vocabulary else None for x in h(text)]
        item = np.array([r.randrange(9) for _ in range(50)])
        left = np.array([r.randrange(300) for _ in range(50)])
        right = np.minimum(left + np.array([r.randrange(40) for _ in range(50)]), 300)
        base, at, mine, common = block.within(item, left, right, number)
        for k in range(50):
            stretch = text[left[k] : right[k]]
            own = slice(base[k], base[k] + len(stretch))
            assert at[own].tolist() == list(range(left[k], right[k])) and mine[own].tolist() == [w in items[item[k]] for w in stretch]
            assert common[k] == (Counter(stretch) & Counter(items[item[k]])).total() >= plain_lcs(items[item[k]], stretch)
    assert leaks.Items([], [], [], np.zeros((0, 2), np.float32), np.zeros(0, np.int64)).numbers(h(text)).tolist() == [-1] * 300
