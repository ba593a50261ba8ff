"""Suffix sorting of one shard by induction, out of core where the shard needs it.

The order of the leftmost S-type suffixes is found from the reduced string of their named substrings; it induces the
order of the L-type suffixes, and these that of the S-type ones. The queues of an induction pass are priority queues
by first symbol in which suffixes of one symbol stay in the order they came: a batch of suffixes is taken from the
least (for S-type: greatest) symbol at a time and its predecessors are put in. Queues that hold more than a budget
move to disk and come back a run at a time.

The order is right to a depth of at least ``depth`` symbols: suffixes that agree that far may stand in any order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Suffixes that the queues of a pass hold in memory, and that one run taken from disk has.
IN_MEMORY, RUN = 16 << 20, 1 << 20

SYMBOLS = 258  # 0: the end of the shard, 1: the end of a segment, 2..257: bytes


class SuffixQueue:
    """First in, first out for each symbol; beyond a budget, a symbol's suffixes go to a file of the task's own."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.budget, self.held = in_memory, 0
        self.parts: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
        self.files: list = [None] * SYMBOLS
        self.folder: tempfile.TemporaryDirectory | None = None

    def put(self, symbols: np.ndarray, suffixes: np.ndarray) -> None:
        """Suffixes in order, each under its symbol."""
        if not len(suffixes):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, suffixes = symbols[order], suffixes[order]
        at = np.flatnonzero(np.diff(symbols, prepend=-1))
        for i, j in zip(at, [*at[1:], len(symbols)], strict=True):
            self.parts[symbols[i]].append(suffixes[i:j])
        self.held += len(suffixes)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffix-queue-")
        for c, parts in enumerate(self.parts):
            if parts:
                if self.files[c] is None:
                    self.files[c] = open(f"{self.folder.name}/{c}", "w+b")  # noqa: SIM115
                for p in parts:
                    p.tofile(self.files[c])
                self.parts[c] = []
        self.held = 0

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        """Everything that was put under ``symbol``, in order, in runs; it is then gone."""
        if f := self.files[symbol]:
            f.seek(0)
            while len(run := np.fromfile(f, np.int64, RUN)):
                yield run
            f.close()
            self.files[symbol] = None
        parts, self.parts[symbol] = self.parts[symbol], []
        self.held -= sum(map(len, parts))
        if parts:
            yield np.concatenate(parts)

    def close(self) -> None:
        for f in self.files:
            if f:
                f.close()
        if self.folder is not None:
            self.folder.cleanup()


def s_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the next one; the last counts as such."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def induce(t: np.ndarray, leftmost: np.ndarray, in_memory: int = IN_MEMORY) -> list[np.ndarray]:
    """All suffixes, by first symbol, given the leftmost S-type ones in order."""
    first = t[leftmost]
    seeds = [leftmost[first == c] for c in range(SYMBOLS)] if len(leftmost) < 4096 else _by_symbol(first, leftmost)
    less: list[np.ndarray] = []
    queue = SuffixQueue(in_memory)
    try:
        for c in range(SYMBOLS):
            done = []
            now = list(queue.take(c))
            while now:
                later = []
                for run in now:
                    done.append(run)
                    before = run[run > 0] - 1
                    symbol = t[before]
                    queue.put(symbol[symbol > c], before[symbol > c])
                    if (same := symbol == c).any():
                        later.append(before[same])
                now = later
            less.append(np.concatenate(done) if done else np.zeros(0, np.int64))
            before = seeds[c][seeds[c] > 0] - 1
            queue.put(t[before], before)
    finally:
        queue.close()
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * SYMBOLS
    queue = SuffixQueue(in_memory)
    try:
        for c in range(SYMBOLS - 1, -1, -1):
            done = []
            now = list(queue.take(c))
            while now:
                later = []
                for run in now:
                    done.append(run)
                    before = run[run > 0] - 1
                    symbol = t[before]
                    queue.put(symbol[symbol < c], before[symbol < c])
                    if (same := symbol == c).any():
                        later.append(before[same])
                now = later
            down = less[c][::-1]
            before = down[down > 0] - 1
            symbol = t[before]
            queue.put(symbol[symbol < c], before[symbol < c])
            greater = np.concatenate(done)[::-1] if done else np.zeros(0, np.int64)
            out[c] = np.concatenate([less[c], greater])
    finally:
        queue.close()
    out[0] = np.array([len(t) - 1])
    return out


def _by_symbol(symbols: np.ndarray, suffixes: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(symbols, kind="stable")
    return np.split(suffixes[order], np.searchsorted(symbols[order], np.arange(1, SYMBOLS)))


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _names(t: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the substrings from each leftmost S-type suffix (``at``, ascending) to the next, in their order
    (``order``: their places in ``at``)."""
    n = len(t)
    size = np.diff(np.append(at, n))
    place = np.arange(at[0], n) - np.repeat(at, size)
    power = np.full(int(size.max()), _MULTIPLIER)
    power[0] = 1
    power = np.multiply.accumulate(power)
    code = np.add.reduceat((t[at[0] :].astype(np.uint64) + np.uint64(0x51ED27)) * _MULTIPLIER * power[place], at - at[0])
    last = np.append(t[at[1:]], 0).astype(np.uint64)
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + last * np.uint64(0x94D049BB133111EB) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    sorted_code = code[order]
    name = np.zeros(len(at), np.int64)
    name[order] = np.cumsum(np.diff(sorted_code, prepend=sorted_code[:1]) != 0)
    return name


def _sort_reduced(name: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The order of the reduced string's suffixes, by doubling in memory; a name stands for two symbols at least.

    ``order`` sorts the names. A suffix's rank is the place of the first of those that it can't be told from yet; in
    each round only these are sorted, within their places."""
    n = len(name)

    def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return first, np.diff(np.append(first, len(keys)))

    first, size = groups(name[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    left, h, order = np.flatnonzero(np.repeat(size, size) > 1), 1, order.copy()
    while 2 * h < depth and len(left):
        own = order[left]
        key = rank[own] << 32
        inside = own + h < n
        key[inside] |= rank[own[inside] + h] + 1
        by = np.argsort(key, kind="stable")
        own = own[by]
        order[left] = own
        first, size = groups(key[by])
        rank[own] = np.repeat(left[first], size)
        left, h = left[np.repeat(size, size) > 1], 2 * h
    return order


def suffix_order(t: np.ndarray, depth: int, in_memory: int = IN_MEMORY) -> np.ndarray:
    """Start places of the suffixes of ``t`` (symbols as above; the last is 0 and no other is) in order."""
    s = s_types(t)
    leftmost = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(leftmost) > 1:
        number = np.full(len(t), -1)
        number[leftmost] = np.arange(len(leftmost))
        by = number[np.concatenate(induce(t, leftmost, in_memory))]
        order = by[by >= 0]
        leftmost = leftmost[_sort_reduced(_names(t, leftmost, order), order, depth)]
    return np.concatenate(induce(t, leftmost, in_memory))


def symbols(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One shard of the segments: its symbols, and where each segment begins and ends."""
    size = np.array([len(s) for s in segments], np.int64)
    start = np.cumsum(size + 1) - (size + 1)
    raw = np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8)
    t = raw.astype(np.int16) + 2
    t[start + size] = 1
    t[-1] = 0
    return t, start, start + size


def repeated_starts(segments: list[bytes], copies: np.ndarray, length: int, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place) at which a string of ``length`` bytes starts that also starts anywhere else; a segment with
    more than one copy repeats all of its own. Strings don't reach over a segment's end."""
    t, start, end = symbols(segments)
    order = suffix_order(t, length + 1, in_memory)
    owner = np.repeat(np.arange(len(segments)), end - start + 1)
    owner = np.append(owner, len(segments) - 1)
    order = order[order + length <= end[owner[order]]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # common prefixes of neighbours, eight symbols' bytes at a time
    data = b"\0".join(segments) + b"\0" * 9
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    same = np.arange(len(order) - 1)
    if length < 8:
        mask = np.uint64((1 << 8 * length) - 1)
        same = same[words[order[same]] & mask == words[order[same + 1]] & mask]
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else [])]:
        same = same[words[order[same] + k] == words[order[same + 1] + k]]
    hit = copies[owner[order]] > 1
    hit[same] = True
    hit[same + 1] = True
    # a group with a copied segment is hit as a whole already: every other member has an equal neighbour
    at = order[hit]
    return owner[at], at - start[owner[at]]
