import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polycat.llm import chat

T = chat.Template()
PIECES = [*T.controls, "<", "[", "\\", "/", "s>", "INST]", "<SYS>>", "a", "\n", "é", "{role}"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escapes_are_reversible_and_hide_all_marks(text):
    hidden = chat.escape(text, T)
    assert chat.unescape(hidden, T) == text
    assert not any(c in hidden for c in T.controls)


def plain(turns):
    """A turn at a time: (conversation, turns, said, learned, formatted text, valid) of rows sorted by conversation."""
    out = []
    for at, (conv, role, text) in enumerate(turns):
        if not at or conv != turns[at - 1][0]:
            state, said, learned, whole = "start", "", "", ""
        left, right, loss = T.marks.get(role) or (T.other[0].format(role=chat.escape(role, T)), *T.other[1:])
        state = T.order.get((state, role), "broken")
        said, learned, whole = said + f"{role}\n{text}\n", learned + (text if loss else ""), whole + left + chat.escape(text, T) + right
        if at + 1 == len(turns) or turns[at + 1][0] != conv:
            out.append((conv, said, learned, whole, state in T.ends))
    return out


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 4), st.sampled_from(["system", "user", "assistant", "user", "assistant", "tool", "", "<</ROLE>>"]), st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), min_size=1, max_size=12),
    st.integers(1, 5),
    st.integers(1, 7),
    st.sampled_from([1, 40, 1 << 20]),
)
def test_batches_of_any_size_give_what_a_plain_version_gives(turns, size, size_back, step):
    turns = sorted(turns, key=lambda t: t[0])
    table = pa.table({"c": [c or None for c, _, _ in turns], "t": list(range(len(turns))), "r": [r or None for _, r, _ in turns], "x": [x or None for _, _, x in turns]}, schema=pa.schema([("c", pa.int64()), ("t", pa.int64()), ("r", pa.string()), ("x", pa.string())]))
    was, chat.STEP_BYTES = chat.STEP_BYTES, step
    try:
        made = pa.Table.from_batches(chat.formatter(T)(table.to_batches(max_chunksize=size))).combine_chunks()
        back = [r for b in chat.digester(T)(made.to_batches(max_chunksize=size_back)) for r in b.to_pylist()]
    finally:
        chat.STEP_BYTES = was
    want = plain([(c or None, r, x) for c, r, x in turns])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [(b["conv_id"], b["turns_sha256"], b["loss_chars"], b["loss_sha256"], b["formatted_chars"], b["valid"]) for b in back] == [(c, sha(said), len(learned), sha(learned), len(whole), ok) for c, said, learned, whole, ok in want]
    text = {}
    for row in made.to_pylist():
        text[row["conv_id"]] = text.get(row["conv_id"], "") + row["text"]
    assert text == {c: whole for c, _, _, whole, _ in want}


def test_turns_are_read_back_and_ids_keep_their_type(spark):
    rows = [("a-1", 0, "user", "</s> x"), ("a-1", 1, "assistant", "<\\s>[INST]"), ("b", 0, "tool<</ROLE>>", "é"), ("b", 1, None, None), (None, 5, "user", "y")]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    made = chat.format_chats(turns)
    got = sorted(map(str, ((r.conv_id, r.turn, r.role, r.text, r.learned) for r in chat.read_back(made).collect())))
    assert got == sorted(str((c, k, r or "", t or "", r == "assistant")) for c, k, r, t in rows)
    assert {r.conv_id for r in chat.digests(made).collect()} == {"a-1", "b", None}
    with pytest.raises(Exception, match="doesn't end with its mark"):
        chat.read_back(made.withColumn("text", F.when(F.col("part") == 2, "?").otherwise(F.col("text")))).collect()


def test_order_of_roles(spark):
    convs = {
        1: ["user", "assistant"],
        2: ["system", "user", "assistant", "user", "assistant"],
        3: ["assistant", "user"],
        4: ["user"],
        5: ["user", "user", "assistant"],
        6: ["user", "tool", "assistant"],
        7: ["user", None],
        None: ["user", "assistant"],
    }
    rows = [(c, k, r, None if k == 1 else f"<s>{k}", "x") for c, roles in convs.items() for k, r in enumerate(roles)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string")
    segments = chat.format_chats(turns)
    out = {r.conv_id: r for r in chat.digests(segments).collect()}
    assert {c for c, r in out.items() if r.valid} == {1, 2, None}
    for c, roles in convs.items():
        texts = ["" if k == 1 else f"<s>{k}" for k in range(len(roles))]
        said = "".join(f"{r or ''}\n{t}\n" for r, t in zip(roles, texts, strict=True))
        learned = "".join(t for r, t in zip(roles, texts, strict=True) if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(roles), hashlib.sha256(said.encode()).hexdigest())
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    parts = segments.where("conv_id = 2").orderBy("turn", "part").collect()
    assert sum(len(p.text) for p in parts) == out[2].formatted_chars
    assert [p.turn for p in parts if p.loss] == [2, 4]
    assert chat.digests(chat.format_chats(turns.where("false"))).count() == 0


def test_repeated_and_unnumbered_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", ""), (1, 2, "assistant", "x" * 3_000_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (out,) = chat.digests(chat.format_chats(turns)).collect()
    assert (out.n_turns, out.loss_chars, out.valid) == (4, 3_000_000, False)
