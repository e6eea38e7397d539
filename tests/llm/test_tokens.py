import random

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from polycat.llm import tokens  # noqa: E402
from polycat.llm.arrays import steps, text_bytes  # noqa: E402

PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tool():
    return tokens.compiled(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def counted(tool, texts, limit=1 << 14):
    data, off = text_bytes(pa.array(texts, pa.string()))
    return np.concatenate([tool.count(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in steps(off, limit)]).tolist()


def wanted(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_marks_spaces_contractions_and_special_strings(tool, library):
    r = random.Random(3)
    parts = ["a", "'", "'s", "'re", "'l", "'ll", "'ve", "'d", " ", "  ", "\n", "\t", "1", "é", "!", "<|endoftext|>", "<|endof", "the", "日本", "　", "😀", "r", "l", "'S"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    texts += ["", None, " ", "a" * 3000, " " * 999, "\n" * 99 + "x", "<|endoftext|>" * 5, "  <|endoftext|>  "]
    assert counted(tool, texts) == wanted(library, texts)


def test_any_code_points(tool, library):
    r = random.Random(4)
    some = lambda: chr(r.choice([r.randint(32, 126), r.randint(0, 0x2FFF), r.randint(0, 0x10FFFF)]))
    texts = ["".join(some() for _ in range(r.randint(0, 25))).encode("utf-8", "ignore").decode() for _ in range(4000)]
    assert counted(tool, texts) == wanted(library, texts)


def test_counts_dont_depend_on_the_size_of_the_table(tool, library):
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghij éü") for _ in range(r.randint(0, 200))) for _ in range(300)]
    merges = tool.parts[1]
    full, merges.CAP = merges.CAP, 3000
    merges.reset()
    try:
        assert counted(tool, texts, 1 << 12) == wanted(library, texts)
    finally:
        merges.CAP = full
        merges.reset()


def test_long_pieces_are_read_in_lanes(tool, library):
    r = random.Random(7)
    letters = "".join(r.choice("abcdefghijklmnop") for _ in range(30000))
    texts = [letters, "a" * 20001, "ab" * 9000, "=" * 9999, "the" * 4000 + "x" + "the" * 4000, "é" * 7000, letters[:4097], letters[:4096] + " " + letters[:5000]]
    want = wanted(library, texts)
    assert counted(tool, texts) == want
    merges = tool.parts[1]
    kept = merges.CAP, merges.LONG, merges.LANE, merges.WARM
    try:
        for merges.LONG, merges.LANE, merges.WARM in ((50, 7, 0), (100, 33, 5), (64, 64, 64)):
            assert counted(tool, texts[1:]) == want[1:]
        merges.CAP, merges.LONG, merges.LANE, merges.WARM = 2500, 1000, 50, 20
        merges.reset()
        assert counted(tool, texts) == want
    finally:
        merges.CAP, merges.LONG, merges.LANE, merges.WARM = kept
        merges.reset()


def test_pairs_follow_as_the_merges_say(tool):
    merges, r = tool.parts[1], random.Random(6)
    for _ in range(400):
        a, b = r.randrange(len(merges.strings)), r.randrange(len(merges.strings))
        x, y = merges.strings[a], merges.strings[b]
        assert merges.may_follow(a, b) == (merges.merged(x + y) == [x, y])


def test_cuts_across_chunks(tool):
    pieces = tool.parts[0]
    classes = np.random.default_rng(1).integers(0, tokens.CLASSES, 5000).astype(np.uint8)
    classes[0] = tokens.BREAK
    one = pieces.starts(classes)
    for width in (1, 7, 5001):
        other = tokens.Pieces(pieces.table)
        other.CHUNK = width
        assert (other.starts(classes) == one).all()


def test_operator_on_rows(spark, tool, library):
    rows = [(1, None, "x"), (2, "", None), (None, "a b", "y"), (2, "the the" * 2000, "z"), (2, "the the" * 2000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = tokens.token_counts(docs, tool).collect()
    assert out[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == sorted((d or 0, len((t or "").encode()), n, n > 1024) for (d, t, _), n in zip(rows, wanted(library, [t for _, t, _ in rows]), strict=True))
    assert tokens.token_counts(docs.where("false"), tool).count() == 0
