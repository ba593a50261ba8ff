"""Periodic runs of words, found from Lyndon arrays over ordered alphabets (Ellert and Fischer), and their removal.

A run is a stretch of words that repeats with a smallest period and that no neighbouring word extends. For one of the
two orders of the alphabet (as given, and reversed) each of its Lyndon roots is the longest Lyndon word at its place,
so that the next smaller suffix stands one period further on. Both Lyndon arrays come from one pass each from left to
right, which compares symbols only: how far two suffixes agree is taken over from the suffixes that they repeat, so
each word is matched a bounded number of times. No suffix structure, no hashes.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_slices, text_buffer

#: Runs of at least so many words that hold their period at least so often.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Beyond so many words numbers are kept in arrays instead of lists: slower, a quarter of the memory.
LISTED = 200_000

#: White space that ends words: blank, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def lyndon(s: Sequence[int]) -> tuple[Sequence[int], Sequence[int]]:
    """For the symbols ``s[:-1]`` (``s[-1]`` is less than all others): the place of the next smaller suffix of each
    suffix, the end if there is none, and how many symbols the two have in common.

    ``base``, ``copy``: of the pairs of suffixes compared so far one that reaches furthest, up to ``reach``. What
    begins within the copy begins in the base too, and has been compared there; symbols are compared from ``reach`` on
    only, or where one comparison decides. A suffix's chain of smaller ones is walked with the agreements known: of
    unequal ones the lesser holds.
    """
    n = len(s) - 1
    new = (lambda x: [x] * (n + 1)) if n <= LISTED else (lambda x: array("i", [x]) * (n + 1))
    after, after_same, before, before_same = new(n), new(0), new(-1), new(0)
    base = copy = reach = 0
    for r in range(1, n):
        x, same = r - 1, 0
        shift = copy - base
        there = r - shift if r < reach else -1
        while True:
            if there >= 0:
                y = x - shift if x >= copy else x
                known = after_same[y] if after[y] == there else before_same[there] if before[there] == y else 0
                if known > reach - r:
                    known = reach - r
                if known > same:
                    same = known
            i, j = x + same, r + same
            if s[i] == s[j]:
                i += 1
                j += 1
                while s[i] == s[j]:
                    i += 1
                    j += 1
                same = j - r
            if j >= reach:
                base, copy, reach, there = x, r, j, -1
            if s[i] < s[j]:
                before[r], before_same[r] = x, same
                break
            after[x], after_same[x] = r, same
            p, least = before[x], before_same[x]
            while p >= 0 and least > same:  # the smaller suffix agrees with x for longer than r does: it is greater too
                after[p], after_same[p] = r, same
                if r + same >= reach:
                    base, copy, reach, there = p, r, r + same, -1
                p, least = before[p], before_same[p]
            if p < 0:
                break
            if least < same:  # r agrees with x beyond the place where the smaller suffix is less
                before[r], before_same[r] = p, least
                break
            x = p
    return after, after_same


def needed(period: int, least: int = LEAST_WORDS, exponent: float = LEAST_EXPONENT) -> int:
    return max(least, math.ceil(exponent * period))


def runs(codes: np.ndarray, least: int = LEAST_WORDS, exponent: float = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least ``least`` symbols and ``exponent`` (2 or more) periods, sorted."""
    n = len(codes)
    found = set()
    if n < max(2, least):
        return []
    places = np.arange(n)
    for symbols in (codes, int(codes.max()) - codes):
        s = symbols.tolist() if n <= LISTED else array("i", symbols.astype(np.int32).tobytes())
        s.append(-1)
        after, same = (np.array(x[:n], np.int64) for x in lyndon(s))
        period = after - places
        # the leftmost root of a run begins less than a period after it, so that much may be missing on its left
        enough = same + 2 * period > np.maximum(least, np.ceil(exponent * period))
        enough &= after < n
        for x in np.flatnonzero(enough).tolist():
            p, first = int(period[x]), x
            if x >= p and after[x - p] == x and same[x - p] >= p:
                continue  # the same run has a root before this one
            while first and s[first - 1] == s[first - 1 + p]:
                first -= 1
            length = x + p + int(same[x]) - first
            if length >= needed(p, least, exponent):
                found.add((first, length, p))
    return sorted(found)


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of the texts, and each text's first word (and the last's end)."""
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    cut = off[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut - 1] & inside[cut]]  # a word also ends where its text does
    start, end = np.sort(np.concatenate([edge[::2], cut])), np.sort(np.concatenate([edge[1::2], cut]))
    return start, end, np.searchsorted(start, off, "left")


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``start:end`` of ``data`` one after the other, a blank after those with ``gap``; their offsets."""
    size = end - start + gap
    off = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    out = data[np.minimum(place, max(0, len(data) - 1))]
    out[(off[1:] - 1)[gap]] = 32
    return out, off


def _found(texts: pa.Array, least: int, exponent: float) -> tuple[pa.Array, pa.Array]:
    """Each text's runs, and the text without what its runs repeat."""
    data, off = text_buffer(texts)
    start, end, first = word_bounds(data, off)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    flat, at = gathered(data, start, end, np.zeros(len(start), bool))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)])
    codes = np.asarray(words.dictionary_encode().indices).astype(np.int64) if len(start) else np.zeros(0, np.int64)
    keep = np.ones(len(start), bool)
    found: list[tuple[int, int, int, int]] = []
    for k in np.flatnonzero(n >= least).tolist():
        a, b = int(first[k]), int(first[k + 1])
        for s, length, p in runs(codes[a:b], least, exponent):
            found.append((k, s, length, p))
            keep[a + s + p : a + s + length] = False
    rows = np.array(found, np.int64).reshape(-1, 4)
    lists = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(rows[:, 0], np.arange(len(n) + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in (1, 2, 3)], ["start", "length", "period"]),
    )
    gap = np.concatenate([doc[keep][1:] == doc[keep][:-1], [False]]) if keep.any() else np.zeros(0, bool)
    flat, at = gathered(data, start[keep], end[keep], gap)
    ends = at[np.searchsorted(doc[keep], np.arange(len(n) + 1))]
    kept = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat))
    return lists, kept


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, exponent: float = LEAST_EXPONENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, runs, collapsed``, a row for each row of ``docs``: the text's runs (word number of the start, length
    and period in words) by start, then period, and its words, joined by one blank, of which each run keeps its first
    period only.

    Words are what white space (blank, tab to carriage return) parts, to the byte. A null or empty text, or one of
    blanks, has no runs and an empty collapsed text; repeated rows each count; a null doc_id is kept; other columns
    are ignored; an empty table gives no rows. Each text is looked at whole, in the task that has its row: no shuffle.
    """
    bounded_batches(docs.sparkSession)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, kept = _found(batch.column(1), least, exponent)
        return pa.RecordBatch.from_arrays([batch.column(0), lists, kept.cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(by_slices(each, "text"), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in each document whose id's crc32 h ends in 0, the words from a on repeat the p words at a,
    where g = h div 10, a = g mod n and p = 1 + (n - a) div (3 + g mod 8), n being its number of words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_w"), g.alias("_g"))
    n = F.size("_w")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = F.sequence(F.lit(0), n - 1)
    i = lambda k: F.when(k < F.col("_a"), k).otherwise(F.col("_a") + (k - F.col("_a")) % F.col("_p")).cast("int")
    repeated = F.array_join(F.transform(place, lambda k: F.get("_w", i(k))), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per document: its number of runs, its longest run (ties: least start, then period) and the digests."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = found.withColumn("_l", longest)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_l.s")).alias("start"),
        F.col("_l.length").alias("length"),
        (-F.col("_l.p")).alias("period"),
        F.floor(F.lit(1000) * F.col("_l.length") / -F.col("_l.p")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
