"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's turns stream in order through the machine, which checks the
order of roles and picks each turn's marks; each turn becomes three segments
(mark, text, mark), each with a loss flag.  Nothing of a conversation is held
but the machine's state, so its length doesn't matter.  Texts stay in Arrow
arrays; only those that have a control string are handled one by one.

Texts are escaped reversibly: where a text has a control string, or one that
was escaped before, a backslash is put after its first character; reading back
takes one backslash out again.  So no text can produce a mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polycat.llm.arrays import steps, text_bytes


@dataclass(frozen=True)
class Template:
    """Marks around the texts of each role, and the order in which roles may come.

    ``marks``: role to (before, after, whether the text is learned from).  Other
    roles get ``other``, whose ``{role}`` is the escaped role.  ``order``: state and
    role to next state; ``ends``: the states in which a conversation may end.
    """

    marks: dict = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
            "user": ("<s>[INST] ", " [/INST]", False),
            "assistant": ("<<ANS>> ", " </s>", True),
        }
    )
    other: tuple = ("<<ROLE>>{role}<</ROLE>>", "<</TURN>>", False)
    controls: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ANS>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>")
    order: dict = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    ends: tuple = ("answered",)

    def _pattern(self, least: int) -> re.Pattern:
        heads = "|".join(f"({re.escape(c[0])})(\\\\{{{least},}})(?={re.escape(c[1:])})" for c in self.controls)
        return re.compile(heads)

    def found(self, least: int) -> str:
        """A pattern without groups for Arrow: control strings with so many backslashes or more after their first character."""
        return "|".join(f"{re.escape(c[0])}\\\\{{{least},}}{re.escape(c[1:])}" for c in self.controls)

    @property
    def escape_pattern(self) -> re.Pattern:
        return self._pattern(0)

    @property
    def unescape_pattern(self) -> re.Pattern:
        return self._pattern(1)


def escape(text: str, template: Template) -> str:
    """``text`` with a backslash more in each control string."""
    return template.escape_pattern.sub(lambda m: m[0] + "\\", text)


def unescape(text: str, template: Template) -> str:
    """The text that was escaped."""
    return template.unescape_pattern.sub(lambda m: m[0][:-1], text)


SEGMENTS = "conv_id {kind}, turn {turn}, role string, part tinyint, text string, loss boolean, state string, last boolean, valid boolean"
NAMES = ["conv_id", "turn", "role", "part", "text", "loss", "state", "last", "valid"]
#: Bytes of text that are handled at once.
STEP_BYTES = 4 << 20


def _changed(texts: pa.Array, pattern: str, change) -> pa.Array:
    """``texts`` with those that match the pattern changed one by one."""
    hit = pc.match_substring_regex(texts, pattern)
    if not pc.any(hit).as_py():
        return texts
    return pc.replace_with_mask(texts, hit, pa.array([change(t) for t in texts.filter(hit).to_pylist()], texts.type))


def _differs(values: pa.Array) -> np.ndarray:
    """Whether each value but the last differs from the next; a null is equal to a null."""
    a, b = values[:-1], values[1:]
    unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unlike | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in held]) for k in range(held[0].num_columns)], names=held[0].schema.names)


class _Machine:
    """The template's machine on numbers: a state and a role give the next state."""

    def __init__(self, template: Template):
        self.template = template
        self.states = ["broken", "start", *dict.fromkeys(v for v in template.order.values() if v not in ("broken", "start"))]
        self.at = self.states.index("start")
        self.ends = np.array([s in template.ends for s in self.states])

    def run(self, roles: list[str], codes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after each turn, and whether each is good; the machine starts anew after a last turn."""
        table = [[self.states.index(self.template.order.get((s, r), "broken")) for r in roles] for s in self.states]
        start, at, out = self.states.index("start"), self.at, []
        for code, end in zip(codes.tolist(), last.tolist(), strict=True):
            at = table[at][code]
            out.append(at)
            if end:
                at = start
        self.at = at
        states = np.array(out, np.int64)
        return states, (states != 0) & (~last | self.ends[states])


def formatter(template: Template):
    """Segments of batches of (conversation, turn, role, text) that come sorted by conversation and turn."""

    def segments(rows: pa.RecordBatch, last: np.ndarray, machine: _Machine) -> pa.RecordBatch:
        n = rows.num_rows
        coded = rows.column(2).fill_null("").dictionary_encode()
        roles, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        marks = [template.marks[r] if r in template.marks else (template.other[0].format(role=escape(r, template)), *template.other[1:]) for r in roles]
        states, good = machine.run(roles, codes, last)
        texts = _changed(rows.column(3).fill_null(""), template.found(0), lambda t: escape(t, template))
        left, right = (pa.array([m[k] for m in marks], pa.string()).take(pa.array(codes)) for k in (0, 1))
        order = pa.array(np.arange(3 * n).reshape(3, n).T.ravel())
        each = pa.array(np.repeat(np.arange(n), 3))
        loss = np.zeros((n, 3), bool)
        loss[:, 1] = np.array([m[2] for m in marks], bool)[codes]
        columns = [rows.column(0).take(each), rows.column(1).take(each), coded.dictionary.take(coded.indices).take(each), pa.array(np.tile(np.arange(3, dtype=np.int8), n)), pa.concat_arrays([left, texts, right]).take(order)]
        columns += [pa.array(loss.ravel()), pa.array(machine.states, pa.string()).take(pa.array(np.repeat(states, 3))), pa.array(np.repeat(last, 3)), pa.array(np.repeat(good, 3))]
        return pa.RecordBatch.from_arrays(columns, names=NAMES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, held = _Machine(template), []
        for batch in _ended(batches):
            held += [] if batch is None else [batch]
            if not held:
                continue
            rows = _whole(held)
            # Whether the last row ends its conversation is for the next batch to say.
            n = rows.num_rows - (batch is not None)
            last = np.append(_differs(rows.column(0)), True)[:n]
            _, offsets = text_bytes(rows.column(3))
            for a, b in steps(offsets[: n + 1], STEP_BYTES):
                yield segments(rows.slice(a, b - a), last[a:b], machine)
            held = [rows.slice(n)] if batch is not None else []

    return run


def _ended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, and None after them."""
    yield from (b for b in batches if b.num_rows)
    yield None


def format_chats(turns: DataFrame, template: Template | None = None, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of all conversations, in order within each partition; a conversation is never cut by one.

    Returns conv_id, turn, role, part (0 mark, 1 text, 2 mark), text, loss (whether
    the segment is learned from), state (of the machine after the turn), last
    (the conversation's last turn) and valid (false from the turn on that breaks
    the order; on the last turn also where the conversation can't end there).
    Nothing is dropped; no rows give none.  A null text or role is empty; an unknown role is marked
    as such, and valid is false.  Ids and turns keep their types.  Rows with a null conv_id are one conversation;
    turns of one number are ordered by role and text, and a null turn comes first.
    Other columns aren't read.  A conversation is in one task, which holds a batch of
    its turns at a time; one text takes some ten times its size.
    """
    template = template or Template()
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return dealt.mapInArrow(formatter(template), SEGMENTS.format(kind=kinds["conv_id"], turn=kinds["turn"]))


@dataclass
class _Read:
    """Whole turns that were read back: segments' columns, and roles, texts and what is learned from."""

    rows: pa.RecordBatch
    roles: pa.Array
    texts: pa.Array
    learned: pa.Array
    n_learned: np.ndarray
    formatted: np.ndarray


def _read_back(batches: Iterable[pa.RecordBatch], template: Template) -> Iterator[_Read]:
    """Turns from formatted text and loss flags alone: the marks say whose they are, and what is between them is unescaped."""
    bare = {left: (role, right) for role, (left, right, _) in template.marks.items()}
    before, after = template.other[0].split("{role}")

    def opened(mark: str) -> tuple[str, str]:
        if mark in bare:
            return bare[mark]
        if not (mark.startswith(before) and mark.endswith(after)):
            raise ValueError("a turn doesn't begin with a mark")
        return unescape(mark[len(before) : len(mark) - len(after)], template), template.other[1]

    held: list[pa.RecordBatch] = []
    for batch in _ended(batches):
        held += [] if batch is None else [batch]
        if not held:
            continue
        rows = _whole(held)
        n = rows.num_rows - rows.num_rows % 3
        if batch is None and n < rows.num_rows or (rows.column(3)[:n].to_numpy().reshape(-1, 3) != np.arange(3)).any():
            raise ValueError("a turn hasn't three segments")
        held = [rows.slice(n)] if n < rows.num_rows else []
        _, offsets = text_bytes(rows.column(4))
        for a, b in steps(offsets[: n + 1 : 3], STEP_BYTES):
            some = rows.slice(3 * a, 3 * (b - a))
            marked = some.column(4)
            at = [pa.array(np.arange(k, some.num_rows, 3)) for k in range(3)]
            coded = marked.take(at[0]).dictionary_encode()
            known = [opened(m) for m in coded.dictionary.to_pylist()]
            if not pc.all(pc.equal(pa.array([r for _, r in known], pa.string()).take(coded.indices), marked.take(at[2]))).as_py():
                raise ValueError("a turn doesn't end with its mark")
            bare_text = _changed(marked, template.found(1), lambda t: unescape(t, template))
            loss = some.column(5).to_numpy(zero_copy_only=False)
            sizes = pc.utf8_length(marked).to_numpy().reshape(-1, 3).sum(1)
            yield _Read(some, pa.array([r for r, _ in known], pa.string()).take(coded.indices), bare_text.take(at[1]), bare_text.filter(pa.array(loss)), loss.reshape(-1, 3).sum(1), sizes)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """The turns of formatted conversations: conv_id, turn, role, text, and ``learned`` (whether the text is under the loss mask)."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _read_back(batches, template):
            first = pa.array(np.arange(0, r.rows.num_rows, 3))
            yield pa.RecordBatch.from_arrays([r.rows.column(0).take(first), r.rows.column(1).take(first), r.roles, r.texts, pa.array(r.n_learned > 0)], names=["conv_id", "turn", "role", "text", "learned"])

    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    return segments.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, learned boolean")


def digester(template: Template):
    """Digests of conversations from batches of segments in the formatter's order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, whole, loss, n_loss, n_all = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
        for r in _read_back(batches, template):
            said, said_at = text_bytes(pc.binary_join_element_wise(r.roles, r.texts, "", "\n"))
            learned, learned_at = text_bytes(r.learned)
            said, learned = memoryview(said), memoryview(learned)
            # Where each turn's learned texts begin, in texts, bytes and code points.
            before = np.concatenate([[0], np.cumsum(r.n_learned)])
            points = np.concatenate([[0], np.cumsum(pc.utf8_length(r.learned).to_numpy())])
            length = np.concatenate([[0], np.cumsum(r.formatted)])
            last = r.rows.column(7).to_numpy(zero_copy_only=False)[2::3]
            ends = np.flatnonzero(last)
            out, a = [], 0
            for b in [*(ends + 1).tolist(), *([len(last)] if not len(ends) or ends[-1] < len(last) - 1 else [])]:
                turns += b - a
                whole.update(said[said_at[a] : said_at[b]])
                loss.update(learned[learned_at[before[a]] : learned_at[before[b]]])
                n_loss += int(points[before[b]] - points[before[a]])
                n_all += int(length[b] - length[a])
                if last[b - 1]:
                    out.append((3 * b - 1, turns, whole.hexdigest(), n_loss, loss.hexdigest(), n_all))
                    turns, whole, loss, n_loss, n_all = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                a = b
            if out:
                at = pa.array([o[0] for o in out])
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                columns = [r.rows.column(0).take(at), *(pa.array([o[k] for o in out], t) for k, t in enumerate(types, 1)), r.rows.column(8).take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

    return run


def digests(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation: turns, digest of roles and texts, length and digest of the text under the loss mask, and formatted length.

    ``segments`` as ``format_chats`` returns them; they are read in its order.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"
    return segments.mapInArrow(digester(template or Template()), schema)
