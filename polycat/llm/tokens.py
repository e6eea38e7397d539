"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic transducers count what a byte-level BPE tokenizer emits,
without producing tokens:

* ``Pieces`` reads code points by class and marks where the pre-tokenizer cuts.
  Its states are few, so the map "state before -> state after" of a chunk is an
  element of a finite monoid that is listed once; chunks are mapped side by
  side, their maps are composed by a parallel prefix scan, and a second pass
  over the chunks, now with known first states, emits the cuts.
* ``Merges`` reads the bytes of a piece.  After each byte the tokens of the
  prefix read so far are determined by its last token, which is the one token
  ending there that may stand after the last token of the shorter prefix.  A
  state holds, for each suffix that can still grow into a token, the last token
  before it and how many tokens fewer there were; a transition carries the
  change of the count.  States are made when first met and kept in a table of
  fixed size, which is emptied when full, so results don't depend on it.

A special string inside a text is one token, as the library has it by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from polycat.llm.arrays import LONG_BYTES, is_long, steps, text_bytes, valid

# Classes of code points.
P, L, N, SP, WS, APOS, SHORT, WITH_E, WITH_L, E, BREAK = range(11)
CLASSES = 11
# States: nothing read, in letters, in numbers, in other marks, one space, one other white
# space, more white space ending in a space, or not, an apostrophe that starts a piece, the same
# and r or v, the same and l, a contraction that is complete.
NONE, LETTERS, NUMBERS, MARKS, ONE_SP, ONE_WS, MANY_SP, MANY_WS, AP, AP_E, AP_L, DONE = range(12)
STATES = 12
LETTER_CLASSES = (L, SHORT, WITH_E, WITH_L, E)
HERE, BEFORE_LAST = 1, 2  # a cut before this code point, before the one before it


def _opened(c: int) -> int:
    if c in LETTER_CLASSES:
        return LETTERS
    return {N: NUMBERS, P: MARKS, APOS: AP, SP: ONE_SP, WS: ONE_WS}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and cuts for one code point."""
    if c == BREAK:
        return NONE, BEFORE_LAST if state in (AP_E, AP_L) else 0
    if state in (AP_E, AP_L):
        if c == (E if state == AP_E else WITH_L):
            return DONE, 0
        after, cuts = _step(LETTERS, c)
        return after, cuts | BEFORE_LAST
    if state in (ONE_SP, ONE_WS, MANY_SP, MANY_WS):
        if c in (SP, WS):
            return (MANY_SP if c == SP else MANY_WS), 0
        cuts = BEFORE_LAST if state in (MANY_SP, MANY_WS) else 0
        if state in (ONE_SP, MANY_SP):
            return (MARKS if c == APOS else _opened(c)), cuts
        return _opened(c), cuts | HERE
    if state == AP:
        if c == SHORT:
            return DONE, 0
        if c in (WITH_E, WITH_L):
            return (AP_E if c == WITH_E else AP_L), 0
        state = MARKS
    if (state == LETTERS and c in LETTER_CLASSES) or (state == NUMBERS and c == N) or (state == MARKS and c in (P, APOS)):
        return state, 0
    return _opened(c), HERE


class Pieces:
    """The pre-tokenizer's transducer over code-point classes."""

    CHUNK = 256

    def __init__(self, table: np.ndarray):
        self.table = table
        self.next = np.zeros((STATES, 16), np.uint8)
        self.cuts = np.zeros((STATES, 16), np.uint8)
        for s in range(STATES):
            for c in range(CLASSES):
                self.next[s, c], self.cuts[s, c] = _step(s, c)
        maps = {tuple(range(STATES)): 0}
        self.maps, rows = [tuple(range(STATES))], []
        for m in self.maps:  # grows while it is read: all maps that some string has
            row = []
            for c in range(CLASSES):
                to = tuple(int(self.next[s, c]) for s in m)
                if to not in maps:
                    maps[to] = len(maps)
                    self.maps.append(to)
                row.append(maps[to])
            rows.append(row + [0] * (16 - CLASSES))
        self.grow = np.array(rows, np.int32).ravel()
        self.maps = np.array(self.maps, np.uint8)

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Which code points begin a piece; ``classes`` has a BREAK before each text."""
        n, width = len(classes), self.CHUNK
        chunks = -(-n // width)
        grid = np.full(chunks * width, BREAK, np.uint8)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(chunks, width).T)
        element = np.zeros(chunks, np.int32)
        for column in grid:
            element = self.grow[(element << 4) | column]
        scan, gap = self.maps[element], 1
        while gap < chunks:  # after this, scan[i] is the map of chunks 0 to i together
            scan[gap:] = np.take_along_axis(scan[gap:], scan[:-gap].astype(np.intp), 1)
            gap *= 2
        state = np.empty(chunks, np.uint8)
        state[0], state[1:] = NONE, scan[:-1, NONE]
        nxt, cut = self.next.ravel(), self.cuts.ravel()
        out = np.empty((width, chunks), np.uint8)
        for k, column in enumerate(grid):
            at = (state.astype(np.int32) << 4) | column
            out[k] = cut[at]
            state = nxt[at]
        flags = out.T.ravel()[:n]
        begin = (flags & HERE) != 0
        begin[:-1] |= (flags[1:] & BEFORE_LAST) != 0
        begin[1:] |= (classes[:-1] == BREAK) & (classes[1:] != BREAK)
        begin &= classes != BREAK
        return begin


class Merges:
    """The lazily determinised transducer of a BPE merge list.

    A state is a set of open suffixes of what was read: trie nodes that a token
    may still grow from, each with what may stand before it and how many tokens
    fewer there were.  For a node above few tokens, "what may stand before it"
    is the set of those that may follow the last token; where that set is empty
    the suffix is closed.  So histories that can't matter any more fall together.
    """

    CAP = 1 << 17  # states in the table; rows that no state uses take no memory
    FEW = 24
    #: Pieces of more bytes are read in lanes, each after some bytes to guess its first state from.
    LONG, LANE, WARM = 4096, 512, 256

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        strings = sorted(vocabulary)  # tokens are numbered in this order here: those below a trie node are a range
        number = {s: k for k, s in enumerate(strings)}
        self.strings = strings
        self.rank, self.left, self.right, self.pair = [-1] * len(strings), [-1] * len(strings), [-1] * len(strings), {}
        for k, (x, y) in enumerate(merges):
            t = number[x + y]
            self.pair[number[x], number[y]] = k
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = k, number[x], number[y]
        self.child: list[dict[int, int]] = [{}]
        self.token, self.low, self.high = [-1], [0], [len(strings)]
        for k, word in enumerate(strings):
            at = 0
            for byte in word:
                to = self.child[at].get(byte)
                if to is None:
                    to = self.child[at][byte] = len(self.child)
                    self.child.append({})
                    self.token.append(-1), self.low.append(k), self.high.append(k)
                at = to
                self.high[at] = k + 1
            self.token[at] = k
            self.low[at] = k + 1  # those strictly below the node
        self.open: dict[tuple[int, int], int] = {}
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        #: By state and byte: 0 if not met yet, else the next state times 512, plus 256, plus the change of the count.
        self.to = np.zeros(self.CAP << 8, np.int32)
        self.first = self._state(((0, -1, 0),))

    def _state(self, state: tuple) -> int:
        k = self.number.get(state)
        if k is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
        return k

    def merged(self, piece: bytes) -> list[bytes]:
        """The tokens of ``piece`` by the definition: the lowest rank first, from the left."""
        index = {s: k for k, s in enumerate(self.strings)}
        parts = [index[piece[k : k + 1]] for k in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.pair.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            best = ranks.index(min(ranks))
            if ranks[best] == 1 << 60:
                break
            parts[best : best + 2] = [index[self.strings[parts[best]] + self.strings[parts[best + 1]]]]
        return [self.strings[k] for k in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token b stands after token a when the bytes of both are merged.

        The merges inside a and b are undone from the last to the first; in
        between, the two symbols that meet must not merge before the next merge
        inside (the one on the left goes first if both have a rank).
        """
        rank, upper_a, upper_b = self.rank, 1 << 60, 1 << 60
        while True:
            meets = self.pair.get((a, b))
            if meets is not None and meets < upper_a and meets <= upper_b:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b] or (rank[a] == rank[b] and rank[b] >= 0):
                upper_a, a = rank[a], self.right[a]
            else:
                upper_b, b = rank[b], self.left[b]

    def _before(self, node: int, last: int) -> int:
        """What a state keeps of the last token before a node: -2 - (bits of the tokens below it that may follow), or the token."""
        low, high = self.low[node], self.high[node]
        if high - low > self.FEW:
            return last
        if last == -1:
            return -2 - ((1 << (high - low)) - 1)
        kept = self.open.get((node, last))
        if kept is None:
            if len(self.open) > 1 << 19:
                self.open.clear()
            kept = self.open[node, last] = -2 - sum(1 << (t - low) for t in range(low, high) if self.may_follow(last, t))
        return kept

    def _advance(self, state: tuple, byte: int) -> tuple[tuple, int]:
        grown, ends = [], None
        for node, before, less in state:
            to = self.child[node].get(byte)
            if to is None:
                continue
            token, low = self.token[to], self.low[node]
            if token >= 0 and ends is None and (before == -1 or (self.may_follow(before, token) if before >= 0 else (-2 - before) >> (token - low) & 1)):
                ends = token, less + 1
            if before <= -2:
                below = (-2 - before) >> (self.low[to] - low) & ((1 << (self.high[to] - self.low[to])) - 1)
                kept = -2 - below
            else:
                kept = self._before(to, before)
            if kept != -2:
                grown.append((to, kept, less))
        if ends is None:
            raise ValueError("no token ends here: the vocabulary lacks a byte or isn't closed under merges")
        token, gain = ends
        return (*((n, k, less - gain) for n, k, less in grown), (0, token, 0)), gain

    def _fill(self, wanted: np.ndarray) -> None:
        for key in wanted.tolist():
            state, gain = self._advance(self.states[key >> 8], key & 255)
            self.to[key] = (self._state(state) << 9) + 256 + gain

    def _run(self, data: np.ndarray, begin: np.ndarray, lens: np.ndarray, states: list[tuple] | None = None, ends: bool = False) -> tuple[np.ndarray, list]:
        """Changes of the count over segments of bytes, all advanced together, a byte a step.

        ``states``: where each segment starts (default: nothing read).  With ``ends``
        also the states at the ends.
        """
        if self.CAP - len(self.states) < self.CAP // 4:
            self.reset()
        if states is not None and len(set(states)) > self.CAP // 4:
            half = len(begin) // 2
            parts = [self._run(data, begin[k], lens[k], states[k], ends) for k in (slice(0, half), slice(half, None))]
            return np.concatenate([p[0] for p in parts]), parts[0][1] + parts[1][1]
        order = np.argsort(-lens, kind="stable")
        begin, lens = begin[order], lens[order]
        total = np.zeros(len(order), np.int64)
        state = np.full(len(order), self.first, np.int32) if states is None else np.array([self._state(states[k]) for k in order.tolist()], np.int32)
        last: list = [None] * len(order)
        ascending = lens[::-1]
        m = len(order)
        for k in range(int(lens[0]) + 1 if len(lens) else 0):
            left = len(lens) - int(np.searchsorted(ascending, k, "right"))
            if ends:
                for at in range(left, m):
                    last[at] = self.states[state[at]]
            m = left
            if not m:
                break
            key = (state[:m] << 8) | data[begin[:m] + k]
            to = self.to[key]
            if not to.all():
                wanted = np.unique(key[to == 0])
                if len(self.states) + len(wanted) > self.CAP:
                    # Only states that are still in use survive; the result is the same.
                    live = {int(s): self.states[int(s)] for s in np.unique(state[:m])}
                    self.reset()
                    renamed = np.zeros(max(live) + 1, np.int32)
                    for s, what in live.items():
                        renamed[s] = self._state(what)
                    state[:m] = renamed[state[:m]]
                    key = (state[:m] << 8) | data[begin[:m] + k]
                    wanted = np.unique(key)
                    if len(self.states) + len(wanted) > self.CAP:
                        raise MemoryError("more states at a time than the table has; use smaller steps")
                self._fill(wanted)
                to = self.to[key]
            total[:m] += (to & 511) - 256
            state[:m] = to >> 9
        out = np.empty_like(total)
        out[order] = total
        if ends:
            back: list = [None] * len(order)
            for at, k in enumerate(order.tolist()):
                back[k] = last[at]
            last = back
        return out, last

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece ``data[start:end]``."""
        lens = ends - starts
        out = np.zeros(len(starts), np.int64)
        short = lens <= self.LONG
        # So few pieces at a time that their states fit the table.
        some = np.flatnonzero(short)
        for lo in range(0, len(some), self.CAP // 3):
            part = some[lo : lo + self.CAP // 3]
            out[part] = self._run(data, starts[part], lens[part])[0]
        for k in np.flatnonzero(~short).tolist():
            out[k] = self._long(data, int(starts[k]), int(ends[k]))
        return out

    def _long(self, data: np.ndarray, start: int, end: int) -> int:
        """Tokens of one long piece, its lanes side by side.

        A lane's first state is guessed from the bytes before it.  Going through the
        lanes in order, a lane counts if the one before it ended in the state that
        was guessed; else it is run again from the right one.  Lanes with the same
        bytes and first state are run once.
        """
        total, state = 0, self.states[self.first]
        known: dict[tuple, tuple] = {}
        lanes = np.arange(start, end, self.LANE)
        for lo in range(0, len(lanes), self.CAP // 4):
            at = lanes[lo : lo + self.CAP // 4]
            lens = np.minimum(self.LANE, end - at)
            before = np.maximum(at - self.WARM, start)
            guess = self._run(data, before, at - before, ends=True)[1]
            guess[0] = state
            gains, last = self._run(data, at, lens, guess, ends=True)
            for k in range(len(at)):
                if guess[k] == state:
                    gain, state = int(gains[k]), last[k]
                else:
                    key = (data[at[k] : at[k] + lens[k]].tobytes(), state)
                    if key not in known:
                        if len(known) >= 1 << 12:
                            known.clear()
                        again, to = self._run(data, at[k : k + 1], lens[k : k + 1], [state], ends=True)
                        known[key] = int(again[0]), to[0]
                    gain, state = known[key]
                total += gain
        return total


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character to byte.

    Bytes that print stand for themselves, the others take the code points from
    256 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def code_point_classes() -> np.ndarray:
    """The class of each code point as the library's own pre-tokenizer sees it.

    The library is asked on the driver, once: its tables of letters, numbers and
    white space are of one Unicode version, Python's of another.  Only planes
    with assigned characters are asked about; all others are marks.
    """
    from tokenizers import pre_tokenizers

    ask = pre_tokenizers.ByteLevel(add_prefix_space=False)
    table = np.full(0x110000, P, np.uint8)
    points = np.array([*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)])

    def cut(left: str, right: str, some: np.ndarray) -> np.ndarray:
        """Whether there is a cut before and after each code point between the two marks."""
        asked = ask.pre_tokenize_str("".join(f"{left}{chr(c)}{right}\n" for c in some))
        at = np.zeros(4 * len(some) + 1, bool)
        at[[a for _, (a, _) in asked]] = True
        return np.stack([at[1:-1:4], at[2:-1:4]], 1)

    for k in range(0, len(points), 1 << 14):
        some = points[k : k + (1 << 14)]
        joined, solid = cut("a", "1", some), ~cut("!", "!", some)
        table[some] = np.where(~joined[:, 0], L, np.where(solid.all(1), P, np.where(~joined[:, 1], N, WS)))
    for chars, c in ((" ", SP), ("'", APOS), ("stmd", SHORT), ("rv", WITH_E), ("l", WITH_L), ("e", E)):
        for x in chars:
            table[ord(x)] = c
    return table


class Compiled:
    """A byte-level BPE tokenizer file as transducers; it can be sent to executors."""

    def __init__(self, definition: str, table: np.ndarray):
        self.definition, self.table, self._parts = definition, table, None

    def __getstate__(self):
        return {"definition": self.definition, "table": self.table, "_parts": None}

    @property
    def parts(self) -> tuple[Pieces, Merges, re.Pattern | None]:
        if self._parts is None:
            known = _compiled.get(hash(self.definition))
            self._parts = known if known else self._compile()
            _compiled[hash(self.definition)] = self._parts
        return self._parts

    def _compile(self):
        spec = json.loads(self.definition)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            raise ValueError("only plain byte-level BPE tokenizers without a normalizer can be compiled")
        added = spec["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special strings that look at their surroundings aren't supported")
        to_byte = byte_symbols()
        raw = lambda s: bytes(to_byte[c] for c in s)
        special = {t["content"] for t in added}
        vocabulary = {raw(s): i for s, i in model["vocab"].items() if s not in special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = Merges(vocabulary, [(raw(a), raw(b)) for a, b in pairs])
        pattern = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))).encode()) if special else None
        return Pieces(self.table), merges, pattern

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a slice; a long text in parts that are cut where the pre-tokenizer always cuts."""
        special = self.parts[2]
        if is_long(offsets) and (special is None or b" " not in special.pattern):
            return sum(self._count(data[a:b], np.array([0, b - a])) for a, b in _between_words(data))
        return self._count(data, offsets)

    def _count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        pieces, merges, special = self.parts
        extra = np.zeros(len(offsets) - 1, np.int64)
        owner = np.arange(len(offsets) - 1)
        spans = np.stack([offsets[:-1], offsets[1:]], 1)
        if special is not None:
            found = [(m.start(), m.end()) for m in special.finditer(data.tobytes())]
            rows = [int(np.searchsorted(offsets, a, "right")) - 1 for a, _ in found]
            found = [(a, b, r) for (a, b), r in zip(found, rows, strict=True) if b <= offsets[r + 1]]
            if found:
                lo, hi, who = [], [], []
                by_row: dict[int, list] = {}
                for a, b, r in found:
                    by_row.setdefault(r, []).append((a, b))
                for r in range(len(offsets) - 1):
                    at = int(offsets[r])
                    for a, b in by_row.get(r, ()):
                        lo.append(at), hi.append(a), who.append(r)
                        extra[r] += 1
                        at = b
                    lo.append(at), hi.append(int(offsets[r + 1])), who.append(r)
                spans, owner = np.array([lo, hi]).T, np.array(who)
        if not len(data):
            return extra
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if len(lead) != len(points):
            raise ValueError("a text isn't valid UTF-8")
        classes = pieces.table[points]
        inside = np.zeros(len(data) + 1, np.int32)
        np.add.at(inside, spans[:, 0], 1)
        np.add.at(inside, spans[:, 1], -1)
        inside = np.cumsum(inside)[:-1][lead] > 0
        begin = np.searchsorted(lead, spans[:, 0])
        classes = np.where(inside, classes, BREAK).astype(np.uint8)
        with_breaks = np.insert(classes, begin, BREAK)
        at_break = np.zeros(len(with_breaks), bool)
        at_break[begin + np.arange(len(begin))] = True
        first = pieces.starts(with_breaks)[~at_break]
        starts = lead[first]
        span = np.searchsorted(spans[:, 0], starts, "right") - 1
        ends = np.append(starts[1:], len(data))
        ends = np.minimum(ends, spans[span, 1])
        n = merges.counts(data, starts, ends)
        return extra + np.bincount(owner[span], n, len(offsets) - 1).astype(np.int64)


def _between_words(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a text that end before a space after a printable ASCII character: no piece holds both."""
    at, n, look = 0, len(data), 1 << 16
    while at < n:
        end = at + LONG_BYTES
        while end < n:
            here, before = data[end : end + look], data[end - 1 : end - 1 + look]
            hit = (here == 0x20) & (before[: len(here)] > 0x20) & (before[: len(here)] < 0x7F)
            if hit.any():
                end += int(hit.argmax())
                break
            end += len(here)
        yield at, min(end, n)
        at = end


_compiled: dict[int, tuple] = {}


def compiled(path: str) -> Compiled:
    """The tokenizer file at ``path`` (read on the driver)."""
    with open(path, encoding="utf-8") as f:
        return Compiled(f.read(), code_point_classes())


def token_counts(docs: DataFrame, tokenizer: Compiled, *, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    A null text is empty: 0 bytes and 0 tokens.  Bytes that aren't UTF-8 count as U+FFFD.  Every row gives a row, repeated
    ones too, and rows keep all other columns; a column that has the name of a
    result is replaced.  An empty table gives an empty table.
    """
    results = ("n_bytes", "n_tokens", "over_limit")
    kept = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in results]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_bytes bigint", "n_tokens bigint", "over_limit boolean"])
    names = [f.name for f in kept]
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary file and a table of code points: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = sent.value
        for batch in batches:
            column = batch.column(len(names))
            n_bytes = np.diff(text_bytes(column)[1])
            data, offsets = text_bytes(valid(column))
            n = np.concatenate([np.zeros(0, np.int64), *(tool.count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in steps(offsets))])
            new = [pa.array(n_bytes), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], names=[*names, *results])

    return docs.select(*(f"`{c}`" for c in names), f"`{text}`").mapInArrow(run, schema)
