"""Words and word shingles of many texts at once, as numpy arrays of 64-bit hashes.

A word is a run of bytes between ASCII white space and ASCII punctuation, after Unicode lower-casing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_buffer

_SPACE = np.zeros(256, bool)
_SPACE[[c for c in range(128) if not chr(c).isalnum()]] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 64, 256, np.uint64) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p) if n else p


_POWERS = _powers(1 << 10)


class Words:
    """``hash`` of every word; words of text ``i`` are ``first[i]:first[i + 1]``; ``start``, ``end``: their bytes in
    the lower-cased buffer."""

    def __init__(self, texts: pa.Array):
        data, off = text_buffer(pc.utf8_lower(pc.fill_null(texts, "")))
        inside = ~_SPACE[data]
        edge = np.diff(inside, prepend=False, append=False)
        if len(off) > 2:  # a word also ends where its text does
            cut = off[1:-1]
            cut = cut[(cut > 0) & (cut < len(data))]
            cut = np.unique(cut[inside[cut - 1] & inside[cut]])
        else:
            cut = np.zeros(0, np.int64)
        at = np.flatnonzero(edge)
        self.start, self.end = np.sort(np.concatenate([at[::2], cut])), np.sort(np.concatenate([at[1::2], cut]))
        self.first = np.searchsorted(self.start, off, "left")
        size = self.end - self.start
        powers = _POWERS if not len(size) or size.max() <= len(_POWERS) else _powers(int(size.max()))
        self.hash = np.zeros(len(size), np.uint64)
        if len(size):
            begins = np.cumsum(size) - size
            place = np.arange(begins[-1] + size[-1]) - np.repeat(begins, size)
            value = _BYTE[data[inside]] * powers[place]
            self.hash = mix(np.add.reduceat(value, begins))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words (of all words, where a text has fewer but some), and their text's number,
        ascending."""
        count = np.diff(self.first)
        text = np.repeat(np.arange(len(count)), count)
        total = len(self.hash)
        h = np.zeros(total, np.uint64)
        last = self.first[1:][text] if total else np.zeros(0, np.int64)
        place = np.arange(total)
        for k in range(n):
            i = place + k
            ok = i < last
            h = h * _BASE + np.where(ok, self.hash[np.minimum(i, total - 1)] if total else h, np.uint64(0))
        keep = (place + n <= last) | ((place == self.first[:-1][text]) & (count[text] < n))
        return mix(h[keep]), text[keep]
