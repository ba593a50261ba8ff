"""Packing token sequences into windows by best-fit decreasing.

A document longer than a window is cut into full windows first; the pieces left are dealt into shards by a hash
of all they hold, and within a shard placed in decreasing length into the open window with the least room that still
holds them. A segment tree indexed by remaining room finds that window in O(log window). A shard leaves at most a few
windows partly filled, so the padding does not depend on the number of shards once these hold some thousand pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_slices, tidy
from .tok import default_path, encoder

WINDOW = 4096
#: Tokens of the pieces that one shard places, about; shards are numbered by the input's size.
SHARD_TOKENS = 8 << 20


class RoomTree:
    """Open windows by remaining room: a segment tree over room 0..capacity, each leaf a stack of windows."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """The room and number of the open window with the least room of at least ``need``; it is taken out."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a right neighbour has windows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        window = self.stacks[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece (all lengths 1 to ``capacity``); equal lengths in the order given."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = RoomTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        if found := tree.take_tightest(need):
            room, w = found
        else:
            room, w, opened = capacity, opened, opened + 1
        window[i], offset[i] = w, capacity - room
        if room > need:
            tree.add(room - need, w)
    return window, offset


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids``: each document's ids and the end id, cut into full windows and a rest.

    ``ids`` are little-endian unsigned 32-bit numbers.
    """
    path = tokenizer or default_path()
    bounded_batches(docs.sparkSession)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = encoder(path).encode(batch.column(1))
        n = np.diff(at)
        flat = np.insert(ids.astype("<u4"), at[1:], end_id)
        doc_first = at[:-1] + np.arange(len(n))
        pieces = (n + 1 + window - 1) // window
        doc = np.repeat(np.arange(len(n)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
        length = np.minimum(window, (n + 1)[doc] - start)
        off = (doc_first[doc] + start) * 4
        # pieces lie one after the other in ``flat``
        blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.append(off, len(flat) * 4)), pa.py_buffer(flat)])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array((n + 1)[doc]), blob.cast(pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(by_slices(cut, "text"), "doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(pieces: DataFrame, shards: int, window: int = WINDOW, keys: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``window``) plus ``sequence_id`` and ``offset``; the other columns go along.

    Every piece lies in exactly one sequence, offsets are gapless from 0, no sequence exceeds ``window``. Rows that
    repeat their keys are pieces of their own. An empty table gives no rows.
    """

    def one(rows: pa.Table) -> pa.Table:
        tidy()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(k, "ascending") for k in keys]))
        w, offset = best_fit_decreasing(rows.column("length").to_numpy(), window)
        shard = rows.column("_shard")[0].as_py()
        return rows.select(names).append_column("sequence_id", pa.array(w + (shard << 32))).append_column("offset", pa.array(offset))

    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    # all columns count: pieces of one very long document, or of many under one id or without one, go to many shards
    dealt = pieces.select(*names, F.pmod(F.xxhash64(*names), F.lit(shards)).alias("_shard"))
    return dealt.groupBy("_shard").applyInArrow(one, schema)


def shard_count(docs: DataFrame, text: str = "text") -> int:
    """Shards of about SHARD_TOKENS tokens each, from the bytes of the texts (one pass over a single column)."""
    size = docs.select(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(1, round(size * 0.4 / SHARD_TOKENS))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Packs whole documents: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset``, one row per piece.

    A null or empty text is the end id alone; a null doc_id is kept; repeated rows are packed as often as they occur;
    other columns are ignored; an empty table gives no rows.
    """
    return pack(token_pieces(docs, tokenizer, end_id, window, text, doc_id), shard_count(docs, text), window)
