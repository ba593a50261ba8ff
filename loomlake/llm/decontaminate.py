"""Benchmark decontamination by spaced seeds.

A mask takes some of a run of words and ignores the others; the hashes under fixed masks of all places of the test
items are looked up at all places of the documents. A hit fixes how item and document lie against each other; their
words are compared there one by one, and the overlap is the longest run of the item's words of which the needed share
stands in the document. It counts if it has RUN words, or is the whole of a shorter item: a document that quotes part
of an item, or all of it with a word put in or left out, is found by what is in place on either side.

The test set is taken in blocks of at most BLOCK_WORDS words, each a pass over the documents: what goes to the workers
is bounded however large the test set is, and documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, sliced
from .words import Words, mix

#: Share of an overlap's words that are in place, and words of an overlap (of a shorter item: all).
SIMILARITY, RUN = 0.8, 13
#: Pairs of places that one step compares.
PAIRS = 1 << 20
#: Under these, every placing of substitutions in up to a fifth of an item's words leaves a hit (tests try them all).
MASKS = ("1111", "11101", "10111", "11011")
#: Words of the test set that one pass looks for, and text bytes that a worker looks through at once.
BLOCK_WORDS, SLICE = 400_000, 2 << 20
_FILTER_BITS = 22


def _seed(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hashes under ``mask`` at all places where it fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(salt * 2 + 1))
    for k, c in enumerate(mask):
        if c == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(h)


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        words = Words(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.words, self.first = words.hash, words.first
        size = np.diff(words.first)
        spans = {len(m) for m in MASKS}
        #: An item shorter than the longest mask is looked for whole as well.
        self.masks = [*MASKS, *("1" * n for n in sorted({int(x) for x in size if 0 < x < max(spans)}))]
        seeds, item, place = [], [], []
        for j, mask in enumerate(self.masks):
            for i in range(len(items)):
                own = words.hash[words.first[i] : words.first[i + 1]]
                if j >= len(MASKS) and len(own) != len(mask):
                    continue
                h = _seed(own, mask, j)
                seeds.append(h)
                item.append(np.full(len(h), i))
                place.append(np.arange(len(h)))
        h = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.seeds = h[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, int)).astype(np.int64)[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, int)).astype(np.int64)[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def search(self, texts: pa.Array, least: float, run: int = RUN) -> tuple[np.ndarray, ...]:
        """Of each text and item with an overlap, the one with the most words in place (then the longest, then the
        first): text, item, its place (word of the text at which the item would begin, may be negative), words in
        place, words of the item, the item's word at which the overlap begins, its length."""
        words = Words(texts)
        count = np.diff(words.first)
        placed = []
        for j, mask in enumerate(self.masks):
            h = _seed(words.hash, mask, j)
            at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.seeds, h[at], "left"), np.searchsorted(self.seeds, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            text = np.searchsorted(words.first, at, "right") - 1
            inside = at + len(mask) <= words.first[text + 1]
            at, lo, n, text = at[inside], lo[inside], n[inside], text[inside]
            for part in _pieces(n):
                a, c = at[part], n[part]
                k = np.repeat(lo[part], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                d = np.repeat(a - words.first[text[part]], c) - self.place[k]
                placed.append(np.unique(np.stack([np.repeat(text[part], c), self.item[k], d], 1), axis=0))
        none = tuple(np.zeros(0, np.int64) for _ in range(7))
        if not placed:
            return none
        placed = np.unique(np.concatenate(placed), axis=0)
        size = np.diff(self.first)
        out = []
        for part in _pieces(size[placed[:, 1]]):
            t, i, d = placed[part].T
            n = size[i]
            begins = np.cumsum(n) - n
            k = np.arange(n.sum()) - np.repeat(begins, n)
            where = np.repeat(d, n) + k
            ok = (where >= 0) & (where < np.repeat(count[t], n))
            here = words.hash[np.where(ok, np.repeat(words.first[t], n) + where, 0)]
            same = ok & (here == self.words[np.repeat(self.first[i], n) + k])
            match = np.add.reduceat(same.astype(np.int64), begins)
            for x in np.flatnonzero(match >= least * np.minimum(run, n) - 1e-9):
                own = same[begins[x] : begins[x] + n[x]]
                a, b = longest_run(own, least)
                if b - a >= min(run, n[x]):
                    out.append((t[x], i[x], d[x], int(own[a:b].sum()), n[x], a, b - a))
        if not out:
            return none
        found = np.array(out, np.int64)
        order = np.lexsort((found[:, 2], -found[:, 6], -found[:, 3], found[:, 1], found[:, 0]))
        found = found[order]
        best = np.ones(len(found), bool)
        best[1:] = (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])
        return tuple(found[best].T)


def _pieces(cost: np.ndarray) -> list[slice]:
    """Slices of rows that cost about PAIRS together, or a single dearer row."""
    if not len(cost):
        return []
    total = np.cumsum(cost)
    cuts = np.unique([0, *np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS), "right"), len(cost)])
    return [slice(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def longest_run(same: np.ndarray, least: float) -> tuple[int, int]:
    """The longest (then first) interval of ``same`` of which at least the share ``least`` is true; (0, 0) if none is."""
    sums = np.concatenate([[0.0], np.cumsum(same - (least - 1e-9))])
    best = np.maximum.accumulate(sums[::-1])[::-1]  # the greatest sum from here on: falls
    # for each beginning, the last end whose sum isn't less
    end = len(sums) - np.searchsorted(best[::-1], sums, "left") - 1
    length = np.maximum(end - np.arange(len(sums)), 0)
    a = int(length.argmax())
    return a, a + int(length[a])


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    """The test set in blocks of bounded size, one at a time on the driver."""
    held, n = [], 0
    for r in benchmark.select(F.col(item_id).cast("long"), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        held.append((r[0], r[1]))
        n += len(r[1]) // 2 + 1  # a word and what parts it from the next are two characters at least
        if n >= BLOCK_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def overlaps(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, run: int = RUN, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, place, n_match, n_words, start, length``: each document and test item with an overlap, a run
    of ``run`` or more of the item's words (of a shorter item: all) of which at least the share ``least`` stands in the
    document; of several the one with the most words in place, then the longest, then the first. ``place`` is the
    document's word at which the item would begin, ``start`` the item's word at which the overlap begins.

    Words are lower-cased runs between ASCII white space and punctuation. Null or empty texts and items have no words
    and never match; an item that occurs twice is found twice; rows that repeat a document are rows of their own; null
    ids stay null. Empty tables give no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "item_id", "place", "n_match", "n_words", "start", "length"]
    schema = ", ".join(f"{n} long" for n in names)
    out = None
    for items in _blocks(benchmark, item_id, item_text):
        index = docs.sparkSession.sparkContext.broadcast(Index(items))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for part in sliced(batch, "text", SLICE):
                    t, i, *rest = index.value.search(part.column(1), least, run)
                    if len(t):
                        own = pa.array([index.value.ids[k] for k in i.tolist()], pa.int64())
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t)), own, *map(pa.array, rest)], names)

        found = rows.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, run: int = RUN, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` (all its columns) without the rows whose text has an overlap with a test item (see ``overlaps``); rows
    with null texts stay. One pass for each block of the test set, without a shuffle."""
    bounded_batches(docs.sparkSession)
    for items in _blocks(benchmark, item_id, item_text):
        index = docs.sparkSession.sparkContext.broadcast(Index(items))

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for part in sliced(batch, text, SLICE):
                    t = index.value.search(part.column(part.schema.get_field_index(text)), least, run)[0]
                    keep = np.ones(part.num_rows, bool)
                    keep[t] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
