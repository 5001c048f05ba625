"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The merges are compiled on demand into a transducer over bytes. Its state is the last
emitted token plus the bytes whose tokens are still open; for every open position the
last token of its (unique) encoding is kept. A byte extends these by the one token whose
pair with its predecessor survives merging. A position stays alive while the bytes after
it can still grow into a token; tokens shared by the paths of all live positions are
emitted. So output follows after a lookahead bounded by the longest token, and every
state and transition is computed once and then looked up.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows and
other columns are kept as they are; null ids decode to an empty text.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A space between two visible characters always starts a new piece.
CUT = re.compile(r" (?<=\S )(?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes bytes under merge ranks, one table look-up per byte once states are known."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000, wait: int = 24):
        self.ranks = ranks
        self.wait = wait
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.max_states = max_states
        # trie of the vocabulary: (token or -1) * 2 + (1 if longer tokens begin like this)
        self.nodes = {b[:n]: -1 for b in ranks for n in range(1, len(b))}
        for b, i in ranks.items():
            self.nodes[b] = 2 * i + (b in self.nodes)
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        #: last emitted token, open bytes, last token at each open position, live positions
        self.states: list[tuple[int, bytes, tuple, tuple]] = [(-1, b"", (), (0,))]
        self.ids: dict[tuple[int, bytes], int] = {}
        self.moves: dict[int, tuple[int, tuple]] = {}
        self.ends: dict[int, tuple] = {}

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge made the token; None for a single byte."""
        if token not in self.parts:
            parts, limit = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
            while len(parts) > 2:
                ranks = [self.ranks.get(a + b, limit) for a, b in zip(parts, parts[1:])]
                i = ranks.index(min(ranks))
                if ranks[i] >= limit:
                    raise ValueError(f"token {token!r} cannot be made by merges")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.parts[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.parts[token]

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Tokens that once stood at one edge of ``token``, each with the rank that ended it."""
        out, until = [(token, 1 << 60)], self.ranks[token]
        while (parts := self._split(token)) is not None:
            token = parts[side]
            out.append((token, until))
            until = self.ranks[token]
        return out

    def _stable(self, a: int, b: int) -> bool:
        """Do two neighbouring tokens stay apart? No merge over their border may come first.

        Of equal merges the left one goes first.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            rights = self._edge(self.bytes_of[b], 0)
            known = self.pairs[key] = not any(
                (rank := self.ranks.get(left + right)) is not None
                and rank < left_until
                and rank <= right_until
                for left, left_until in self._edge(self.bytes_of[a], 1)
                for right, right_until in rights
            )
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        last, rest, back, live = self.states[state]
        rest += bytes((byte,))
        find, token, still = self.nodes.get, -1, []
        for start in live:  # longest token first
            node = find(rest[start:])
            if node is None:
                continue
            if node & 1:
                still.append(start)
            if token < 0 and node > 0:
                before = back[start - 1] if start else last
                if before < 0 or self._stable(before, node >> 1):
                    token = node >> 1
        if token < 0:
            raise ValueError("the ranks do not cover every byte")
        still.append(len(rest))
        back += (token,)
        if len(rest) < self.wait:  # reached by one way only
            self.states.append((last, rest, back, tuple(still)))
            return len(self.states) - 1, ()
        return self._emit(last, rest, back, still)

    def _path(self, back: tuple, at: int) -> list[int]:
        path = []
        while at:
            path.append(back[at - 1])
            at -= len(self.bytes_of[back[at - 1]])
        return path[::-1]

    def _emit(self, last: int, rest: bytes, back: tuple, live: list[int]) -> tuple[int, tuple]:
        """Emit what the paths of all live positions share; equal remainders are one state."""
        paths = [self._path(back, i) for i in live]
        done = 0
        while all(len(p) > done for p in paths) and len({p[done] for p in paths}) == 1:
            done += 1
        out = tuple(paths[0][:done])
        cut = sum(len(self.bytes_of[t]) for t in out)
        key = (out[-1] if out else last, rest[cut:])
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append((*key, back[cut:], tuple(i - cut for i in live)))
        return self.ids[key], out

    def _finish(self, state: int, tail: bytes) -> list[int]:
        """Tokens of a short text's end, without new states."""
        last, rest, back, live = self.states[state]
        find, pairs, stable = self.nodes.get, self.pairs.get, self._stable
        rest, back = rest + tail, list(back)
        for end in range(len(back) + 1, len(rest) + 1):
            token, still = -1, []
            for start in live:
                node = find(rest[start:end])
                if node is None:
                    continue
                if node & 1:
                    still.append(start)
                if token < 0 and node > 0:
                    before = back[start - 1] if start else last
                    if before >= 0:
                        apart = pairs((before, node >> 1))
                        if not (stable(before, node >> 1) if apart is None else apart):
                            continue
                    token = node >> 1
            if token < 0:
                raise ValueError("the ranks do not cover every byte")
            back.append(token)
            still.append(end)
            live = still
        return self._path(back, len(back))

    def encode(self, text: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self._reset()
        out: list[int] = []
        state, moves, learned = 0, self.moves, 0
        short = len(text) < self.wait
        for at, byte in enumerate(text):
            step = moves.get(state << 8 | byte)
            if step is None:
                if learned and short:  # a short text adds one state, so its parts pay off
                    return self._finish(state, text[at:])
                learned = 1
                step = moves[state << 8 | byte] = self._move(state, byte)
            state, tokens = step
            if tokens:
                out += tokens
        end = self.ends.get(state)
        if end is None:
            back = self.states[state][2]
            end = self.ends[state] = tuple(self._path(back, len(back)))
        out += end
        return out


class Recent(dict):
    """Look-up of bounded size in two generations, so that what is used often stays."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make, self.older = most, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Cuts a text into pieces by ``pattern`` and encodes each by the transducer.

    Ids (int32) of pieces, and of stretches between two lone spaces, are remembered: up to
    ``2 * remembered`` of each, which take about 200 bytes apiece.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 120_000):
        self.find = regex.compile(pattern).findall
        self.machine = Transducer(ranks)
        self.pieces = Recent(remembered, self._piece)
        self.stretches = Recent(remembered, lambda stretch: self._cut(" " + stretch))

    def _piece(self, piece: str) -> bytes:
        return array("i", self.machine.encode(piece.encode("utf-8", "replace"))).tobytes()

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        first, *stretches = CUT.split(text)
        rest = map(self.stretches.__getitem__, stretches)
        return np.frombuffer(self._cut(first) + b"".join(rest), np.int32)


class Utf8Machine:
    """Incremental UTF-8: bytes in, whole characters out.

    The state is the start of a character that still lacks bytes (at most three). What can
    never become a character is replaced by U+FFFD.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for n in range(1, min(3, len(data)) + 1):
            lead = data[-n]
            if 0x80 <= lead < 0xC0:
                continue
            need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4
            if lead < 0xC2 or lead > 0xF4 or n >= need:
                return 0
            if n > 1:
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[-n + 1] <= high:
                    return 0
            return n
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self._open_tail(data)
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


def decode_stream(ids: Iterable[np.ndarray], table: list[bytes]) -> Iterator[str]:
    """Text of a stream of id blocks; a character split over blocks comes out whole."""
    machine = Utf8Machine()
    for block in ids:
        yield machine.feed(b"".join(map(table.__getitem__, block.tolist())))
    yield machine.finish()


_MODELS: dict[tuple, object] = {}


def _encoder(path: str, pattern: str, remembered: int) -> Encoder:
    key = ("encoder", path, pattern, remembered)
    if key not in _MODELS:
        _MODELS[key] = Encoder(load_ranks(path), pattern, remembered)
    return _MODELS[key]


def _table(path: str) -> list[bytes]:
    key = ("table", path)
    if key not in _MODELS:
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            table[i] = b
        _MODELS[key] = table
    return _MODELS[key]


def _swap(df: DataFrame, source: str, new: dict[str, str], fn) -> DataFrame:
    """``df`` with column ``source`` replaced by the columns ``new`` (all others stay)."""
    rest = [f for f in df.schema if f.name != source]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest]
    fields += [f"`{name}` {kind}" for name, kind in new.items()]
    names = [f.name for f in rest] + list(new)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                at = part.schema.get_field_index(source)
                kept = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays(kept + fn(part.column(at)), names)

    return df.mapInArrow(run, ", ".join(fields))


def encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids",
    decoded: str | None = None, remembered: int = 120_000,
) -> DataFrame:
    """Replace column ``text`` by the array of its ids.

    ``path``: rank file that all workers can read. ``decoded``: name of a further column with
    the text decoded back from the ids. ``remembered``: see :class:`Encoder`; the memory is kept
    from task to task.
    """

    def ids_of(texts: pa.Array) -> list[pa.Array]:
        encoder = _encoder(path, pattern, remembered)
        ids = [encoder.encode(t.as_py() or "") for t in texts]
        ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
        return [lists] + ([_decoded(lists, path)] if decoded else [])

    new = {out: "array<int>"} | ({decoded: "string"} if decoded else {})
    return _swap(df, text, new, ids_of)


def _decoded(lists: pa.Array, path: str, block: int = 4096) -> pa.Array:
    table, texts = _table(path), []
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:]):
        blocks = (flat[i : min(i + block, b)] for i in range(a, b, block))
        texts.append("".join(decode_stream(blocks, table)))
    return pa.array(texts, pa.string())


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Replace column ``ids`` by its text, decoded block by block."""
    whole = df.withColumn(ids, F.coalesce(F.col(ids), F.array().cast("array<int>")))
    return _swap(whole, ids, {out: "string"}, lambda lists: [_decoded(lists, path)])
