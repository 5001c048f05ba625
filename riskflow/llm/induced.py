"""Suffix sorting by induction with bounded memory, and common prefixes on the way.

Suffixes are of type L (larger than their successor) or S; an S suffix after an L one is
marked (S*). The S* suffixes are sorted by naming the substrings between them and sorting
the string of names; all L suffixes are then induced from them in one ascending sweep and
all S suffixes in one descending sweep. A sweep takes suffix tuples (position, common prefix
with the one before) from a priority queue: first character first, in order of arrival. The
queue keeps one run per character and moves runs to disk beyond its bound. The common
prefix of two neighbours is one more than the smallest one between their inducers.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


class RunQueue:
    """Priority queue over characters: each has a run of (position, common prefix) in arrival order.

    At most ``most`` tuples stay in memory; the largest runs go to disk first.
    """

    def __init__(self, chars: int, folder: str | None, most: int = 4_000_000):
        self.runs: list[list[np.ndarray]] = [[] for _ in range(chars)]
        self.sizes = np.zeros(chars, np.int64)
        self.files: dict[int, str] = {}
        self.folder, self.most, self.held, self.made = folder, most, 0, 0

    def push(self, char: int, items: np.ndarray) -> None:
        self.runs[char].append(items)
        self.sizes[char] += len(items)
        self.held += len(items)
        if self.held > self.most and self.folder:
            self._spill(int(np.argmax(self.sizes)))

    def _spill(self, char: int) -> None:
        if char not in self.files:  # a run that is being read stays apart from what arrives
            self.made += 1
            self.files[char] = os.path.join(self.folder, f"run-{id(self)}-{self.made}")
        path = self.files[char]
        with open(path, "ab") as f:
            for items in self.runs[char]:
                f.write(np.ascontiguousarray(items).tobytes())
        self.held -= int(self.sizes[char])
        self.runs[char], self.sizes[char] = [], 0

    def pop(self, char: int, block: int = 1_000_000):
        """The run of a character in order, in blocks; what arrives meanwhile comes last."""
        path = self.files.pop(char, None)
        if path:
            with open(path, "rb") as f:
                while data := f.read(block * 16):
                    yield np.frombuffer(data, np.int64).reshape(-1, 2)
            os.remove(path)
        while self.runs[char] or char in self.files:
            if char in self.files:
                yield from self.pop(char, block)
                return
            items = self.runs[char]
            self.held -= int(self.sizes[char])
            self.runs[char], self.sizes[char] = [], 0
            yield np.concatenate(items)


def _is_s(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last is taken as S of its own."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    out = np.zeros(n, bool)
    if len(change):
        smaller = text[change] < text[change + 1]
        nearest = np.searchsorted(change, np.arange(n - 1))
        known = nearest < len(change)
        out[:-1][known] = smaller[nearest[known]]
    out[-1] = True
    return out


class _Inducer:
    """Hands items on to their predecessors' characters and keeps the prefix minima per character."""

    def __init__(self, text: np.ndarray, chars: int, queue: RunQueue, carry: bool):
        self.text, self.queue, self.carry = text, queue, carry
        self.low = np.zeros(chars, np.int64)  # smallest common prefix since the character's last inducer

    def hand_on(self, items: np.ndarray, able: np.ndarray) -> None:
        """``items``: (position, common prefix with the item before) in sweep order."""
        at = np.flatnonzero(able)
        if not self.carry:
            before = items[at, 0] - 1
            chars = self.text[before]
            order = np.argsort(chars, kind="stable")
            made = np.stack([before[order], np.zeros(len(at), np.int64)], axis=1)
            edges = np.flatnonzero(np.r_[True, np.diff(chars[order].astype(np.int64)) != 0]) if len(at) else []
            for a, b in zip(edges, [*edges[1:], len(at)]):
                self.queue.push(int(chars[order[a]]), made[a:b])
            return
        low = np.minimum.accumulate(items[:, 1])
        if len(at):
            before = items[at, 0] - 1
            chars = self.text[before].astype(np.int64)
            order = np.argsort(chars, kind="stable")
            at, before, chars = at[order], before[order], chars[order]
            first = np.r_[True, chars[1:] != chars[:-1]]
            shared = np.empty(len(at), np.int64)
            shared[first] = np.minimum(self.low[chars[first]], low[at[first]])
            rest = np.flatnonzero(~first)
            if len(rest):
                shared[rest] = _range_min(items[:, 1], at[rest - 1] + 1, at[rest] + 1)
            made = np.stack([before, shared + 1], axis=1)
            edges = np.flatnonzero(first)
            self.low = np.minimum(self.low, low[-1])
            ends = np.r_[edges[1:], len(at)]
            for a, b in zip(edges, ends):
                self.queue.push(int(chars[a]), made[a:b])
            last = at[ends - 1]
            tail = np.full(len(last), 1 << 40)
            open_ = last + 1 < len(items)
            if open_.any():
                suffix_low = np.minimum.accumulate(items[::-1, 1])[::-1]
                tail[open_] = suffix_low[last[open_] + 1]
            self.low[chars[edges]] = tail
        else:
            self.low = np.minimum(self.low, low[-1])


def _range_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minima over ``[start, end)`` by doubling tables."""
    width = end - start
    level = np.floor(np.log2(width)).astype(np.int64)
    out, table = np.empty(len(start), np.int64), values
    for j in range(int(level.max()) + 1):
        if j:
            half = 1 << (j - 1)
            table = np.minimum(table[:-half], table[half:])
        now = level == j
        out[now] = np.minimum(table[start[now]], table[end[now] - (1 << j)])
    return out


def prefix_of(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of different suffixes, at least up to ``most``; the text ends with a unique character."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    per = 8 // text.itemsize  # characters compared at once
    padded = np.r_[text, np.zeros(per, text.dtype)]
    words = np.ndarray(len(text), np.uint64, padded, strides=(text.itemsize,))
    for k in range(0, most, per):
        same = words[a[live] + k] == words[b[live] + k]
        out[live[same]] += per
        ends = live[~same]
        for j in range(per - 1):
            ends = ends[padded[a[ends] + k + j] == padded[b[ends] + k + j]]
            out[ends] += 1
        live = live[same]
        if not len(live):
            break
    return out


def _induce(
    text: np.ndarray, is_s: np.ndarray, marked: np.ndarray, shared: np.ndarray, folder, most, carry: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order with common prefixes, from the S* suffixes in order with theirs."""
    chars = int(text.max()) + 1
    head = text[marked].astype(np.int64)
    starts = np.searchsorted(head, np.arange(chars + 1))
    queue = RunQueue(chars, folder, most)
    sweep = _Inducer(text, chars, queue, carry)
    larger: list[np.ndarray] = []  # L suffixes per character
    for c in range(chars):
        own = []
        for items in queue.pop(c):
            items = items.copy()
            if not own:
                items[0, 1] = 0
            own.append(items)
            p = items[:, 0]
            prev = text[np.maximum(p - 1, 0)]
            sweep.hand_on(items, (p > 0) & (prev >= c))
        larger.append(np.concatenate(own) if own else np.empty((0, 2), np.int64))
        a, b = starts[c], starts[c + 1]
        if b > a:
            items = np.stack([marked[a:b], shared[a:b]], axis=1)
            # an L suffix and an S suffix of one character share its run only; taken as 1 at least
            items[0, 1] = _border(text, larger[c][-1, 0], marked[a]) if carry and len(larger[c]) else 0
            sweep.hand_on(items, items[:, 0] > 0)
    queue = RunQueue(chars, folder, most)
    sweep = _Inducer(text, chars, queue, carry)
    order: list[np.ndarray] = []
    ends = text[-1]
    for c in range(chars - 1, -1, -1):
        own = []
        tail = c == ends  # the last suffix has no inducer and is the smallest S suffix of its character
        for items in queue.pop(c):
            items = items.copy()
            if not own:
                items[0, 1] = 0
            own.append(items)
            p = items[:, 0]
            prev = text[np.maximum(p - 1, 0)]
            sweep.hand_on(items, (p > 0) & (prev <= c) & is_s[np.maximum(p - 1, 0)])
        if tail:
            last = np.array([[len(text) - 1, min(1, sum(map(len, own)))]], np.int64)
            own.append(last)
            sweep.hand_on(last, np.array([len(text) > 1 and bool(is_s[-2])]))
        down = larger[c][::-1]
        small = np.concatenate(own) if own else np.empty((0, 2), np.int64)
        if len(down):
            # seen from above, an item's common prefix is the one with its upper neighbour
            up = np.empty(len(down), np.int64)
            up[1:] = larger[c][::-1][:-1, 1]
            up[0] = _border(text, small[-1, 0], down[0, 0]) if carry and len(small) else 0
            items = np.stack([down[:, 0], up], axis=1)
            p = items[:, 0]
            prev = text[np.maximum(p - 1, 0)]
            sweep.hand_on(items, (p > 0) & (prev < c))
        order.append(np.concatenate([small, np.stack([down[:, 0], up], axis=1)]) if len(down) else small)
    sa_down = np.concatenate(order)
    sa = sa_down[::-1, 0]
    lcp = np.zeros(len(sa), np.int64)
    lcp[1:] = sa_down[::-1, 1][:-1]  # the upper neighbour's common prefix with the one below
    return sa, lcp


def _border(text: np.ndarray, a: int, b: int) -> int:
    k, n = 0, len(text)
    while max(a, b) + k < n and text[a + k] == text[b + k]:
        k += 1
    return k


def _ranks_by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names that fits in memory."""
    n, rank, k = len(names), names.astype(np.int64), 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[: n - k] = rank[k:]
        key = rank * (n + 2) + nxt + 1
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1 or k >= n:
            return order


def suffix_array(text: np.ndarray, folder: str | None = None, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes in order, and each one's common prefix with the one before.

    ``text``: non-negative integers. Runs beyond ``most`` tuples are kept in ``folder``.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.ascontiguousarray(text).astype(np.uint16 if text.max() < 65535 else np.int64)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    # a sentinel smaller than all: the last suffix is S* then
    full = np.r_[text + text.dtype.type(1), text.dtype.type(0)]
    is_s = _is_s(full)
    marked = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    order = marked[np.argsort(full[marked], kind="stable")]
    rough, _ = _induce(full, is_s, order, np.zeros(len(order), np.int64), folder, most, carry=False)
    star = np.zeros(n + 1, bool)
    star[marked] = True
    rough = rough[star[rough]]
    # names: equal substrings up to the next S* get one name
    length = np.empty(n + 1, np.int64)
    length[marked] = np.r_[np.diff(marked) + 1, 1]
    a, b = rough[:-1], rough[1:]
    same = length[a] == length[b]
    at = np.flatnonzero(same)
    same[at] = prefix_of(full, a[at], b[at], int(length[a[at]].max()) if len(at) else 0) >= length[a[at]]
    name = np.empty(n + 1, np.int64)
    name[rough] = np.cumsum(np.r_[0, ~same])
    names = name[marked]
    if names.max() == len(names) - 1:
        sorted_marked = rough
    elif len(names) > most:
        sorted_marked = marked[suffix_array(names, folder, most)[0]]
    else:
        sorted_marked = marked[_ranks_by_doubling(names)]
    shared = np.zeros(len(marked), np.int64)
    shared[1:] = prefix_of(full, sorted_marked[:-1], sorted_marked[1:], n)
    sa, lcp = _induce(full, is_s, sorted_marked, shared, folder, most)
    lcp = lcp[1:]
    lcp[0] = 0
    return sa[1:], lcp


def in_folder(text: np.ndarray, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """:func:`suffix_array` with its runs in a folder of the task that goes when it is done."""
    with tempfile.TemporaryDirectory(prefix="suffix-") as folder:
        return suffix_array(text, folder, most)
