"""Suffix-array dedup: bytes covered by a long string that also starts anywhere else are removed.

Every string of LENGTH bytes is dealt to a shard by its anchor, the least hash of its runs of ANCHOR bytes: equal
strings have equal anchors, so a shard finds all matches of its own by suffix sorting (``induced_sort``). Neighbouring
strings mostly share their anchor and travel as one segment; a segment travels only if its anchor occurs elsewhere,
and once for each block of documents and each different segment. A shard answers to the blocks, which know where
their segments stand: a group of copies costs a shard one segment a block, however many documents are copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffer, tidy
from .induced_sort import repeated_starts
from .words import mix

LENGTH, ANCHOR = 200, 16
#: Bytes of text that are one block, whose anchors go to one share, and whose segments go to one shard, about; bytes of
#: segments that are sorted at once, if several anchors have to be.
BLOCK_BYTES, SHARE_BYTES, SHARD_BYTES, SORT_BYTES = 4 << 20, 64 << 20, 8 << 20, 4 << 20


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """``f`` over every ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out = f(out[:-have], out[have:])
        have *= 2
    n = len(x) - width + 1
    return f(out[:n], out[width - have : width - have + n]) if have < width else out[:n]


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of the texts: (text, first place in ``data``, end, anchor, whether it holds its anchor twice)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64), np.zeros(0, bool))
    n = len(data) - length + 1
    if n <= 0:
        return none
    k = min(ANCHOR, length)
    h = _BYTE[data]
    size, power = 1, np.full(1, np.uint64(0xD6E8FEB86659FD93))
    while size * 2 <= k:
        h = h[:-size] * power + h[size:]
        power, size = power * power, size * 2
    h = mix(h)
    width = length - size + 1  # runs in a string
    least = _sliding(h, width, np.minimum)[:n]
    # strings that lie within one text
    size_of = np.diff(off)
    text = np.repeat(np.arange(len(off) - 1), size_of)[:n]
    last_ones = np.minimum(size_of, length - 1)
    inside = np.repeat(np.tile([True, False], len(size_of)), np.stack([size_of - last_ones, last_ones], 1).ravel())[:n]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none
    stop = inside.copy()
    stop[:-1] &= new[1:] | ~inside[1:]
    last = np.flatnonzero(stop)
    key = least[first]
    # where a run of bytes is the anchor of some string; a segment that holds its anchor twice may repeat a string
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h[: n + width - 1])
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, last + width)
    count = hi - lo
    of = np.repeat(np.arange(len(first)), count)
    place = at[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(of))]
    twice = np.bincount(of[h[place] == key[of]], minlength=len(first)) > 1
    return text[first], first, last + length, key, twice


def _sorted_block(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    t = t.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts = t.column("text")
    data, off = text_buffer(pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks]) if texts.num_chunks else pa.array([], pa.large_string()))
    return t, data, off


def _share(h: np.ndarray, shares: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _segments(texts: pa.Table, again: pa.Table, length: int, shares: int, shards: int):  # noqa: ANN202
    """The block in order, and its segments whose anchor occurs again: distinct ones by (shard, anchor, bytes),
    and for each occurrence the number of its distinct one."""
    t, data, off = _sorted_block(texts)
    _, first, end, key, twice = anchors(data, off, length)
    distinct = np.unique(key)
    bounds = np.searchsorted(_share(distinct, shares), np.arange(shares + 1))
    hit = np.zeros(len(distinct), bool)
    for share, at in zip(again.column("share").to_pylist(), again.column("at"), strict=True):
        hit[bounds[share] + np.frombuffer(at.as_buffer(), "<u4").astype(np.int64)] = True
    mine = np.flatnonzero(hit[np.searchsorted(distinct, key)]) if len(key) else np.zeros(0, np.int64)
    raw = data.tobytes()
    pieces = [(k % shards, k, raw[a:b]) for k, a, b in zip(key[mine].tolist(), first[mine].tolist(), end[mine].tolist(), strict=True)]
    order = sorted(set(pieces))
    number = {p: i for i, p in enumerate(order)}
    return t, data, off, first[mine], end[mine], order, np.array([number[p] for p in pieces], np.int64)


class SubstringDedup:
    def __init__(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH):
        size = docs.select(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
        total = size["b"] or 0
        self.length = length
        self.blocks = max(1, round(total / BLOCK_BYTES), size["n"] >> 17)
        self.shares, self.shards = max(2, round(total / SHARE_BYTES)), max(4, round(total / SHARD_BYTES))
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.pmod(F.xxhash64(doc_id, text), F.lit(self.blocks)).cast("int").alias("block"))

    def repeated_anchors(self) -> DataFrame:
        """``block, share, at``: of a block's distinct anchors (ascending, within a share) those that occur again, by
        place."""
        shares, length = self.shares, self.length

        def emit(t: pa.Table) -> pa.Table:
            tidy()
            _, data, off = _sorted_block(t)
            _, _, _, key, twice = anchors(data, off, length)
            distinct, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            many = count > 1
            many[inverse[twice]] = True
            bounds = np.searchsorted(_share(distinct, shares), np.arange(shares + 1))
            rows = [(s, _packed(distinct[a:b]), _packed(many[a:b])) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            block = t.column("block")[0].as_py()
            return pa.table({"share": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()), "many": pa.array([r[2] for r in rows], pa.binary())})

        def count(t: pa.Table) -> pa.Table:
            tidy()
            keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("keys")]
            many = np.concatenate([np.frombuffer(x.as_buffer(), bool) for x in t.column("many")])
            whole = np.concatenate(keys)
            _, inverse, n = np.unique(whole, return_inverse=True, return_counts=True)
            again = n > 1
            again[inverse[many]] = True
            hit, i, at = again[inverse], 0, []
            for k in keys:
                at.append(_packed(np.flatnonzero(hit[i : i + len(k)]).astype("<u4")))
                i += len(k)
            return pa.table({"block": t.column("block").cast(pa.int32()), "share": t.column("share").cast(pa.int32()), "at": pa.array(at, pa.binary())})

        sent = self.docs.groupBy("block").applyInArrow(emit, "share int, block int, keys binary, many binary")
        return sent.groupBy("share").applyInArrow(count, "block int, share int, at binary")

    def repeated_ranges(self, again: DataFrame) -> DataFrame:
        """``block, at, ranges``: for a block's distinct segments (numbered within the block) the covered ranges."""
        length, shares, shards = self.length, self.shares, self.shards

        def emit(texts: pa.Table, own: pa.Table) -> pa.Table:
            tidy()
            _, _, _, _, _, order, uses = _segments(texts, own, length, shares, shards)
            block = (texts if texts.num_rows else own).column("block")[0].as_py()
            count = np.bincount(uses, minlength=len(order))
            rows, i = [], 0
            while i < len(order):
                j = i
                while j < len(order) and order[j][0] == order[i][0]:
                    j += 1
                part = order[i:j]
                rows.append((order[i][0], i, _packed(np.array([p[1] for p in part], np.uint64)), _packed(np.minimum(count[i:j], 2).astype(np.uint8)), _packed(np.array([len(p[2]) for p in part], "<u4")), b"".join(p[2] for p in part)))
                i = j
            names = ("shard", "at", "keys", "copies", "sizes", "bytes")
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.table({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))} | {"block": pa.array([block] * len(rows), pa.int32())})

        def search(t: pa.Table) -> pa.Table:
            tidy()
            found: dict[tuple[int, bytes], list] = {}  # distinct segments of the shard: copies, and where they are
            for row in range(t.num_rows):
                keys = np.frombuffer(t.column("keys")[row].as_buffer(), np.uint64).tolist()
                copies = np.frombuffer(t.column("copies")[row].as_buffer(), np.uint8).tolist()
                sizes = np.frombuffer(t.column("sizes")[row].as_buffer(), "<u4").tolist()
                raw, i = t.column("bytes")[row].as_py(), 0
                for k, (key, c, n) in enumerate(zip(keys, copies, sizes, strict=True)):
                    own = found.setdefault((key, raw[i : i + n]), [0, []])
                    own[0] += c
                    own[1].append((row, k))
                    i += n
            by_key: dict[int, list] = {}
            for (key, raw), own in found.items():
                by_key.setdefault(key, []).append((raw, own[0], own[1]))
            replies: list[list] = [[] for _ in range(t.num_rows)]

            def reply(uses: list, ranges: list) -> None:
                for row, k in uses:
                    replies[row] += [(k, a, b) for a, b in ranges]

            held, size = [], 0
            def sort_held() -> None:
                seg, at = repeated_starts([h[0] for h in held], np.array([h[1] for h in held]), length)
                order = np.lexsort((at, seg))
                seg, at = seg[order], at[order]
                cut = np.flatnonzero((np.diff(seg, prepend=-1) != 0) | (np.diff(at, prepend=-length - 1) > length))
                for a, b in zip(cut, [*cut[1:], len(seg)], strict=True):
                    reply(held[seg[a]][2], [(int(at[a]), int(at[b - 1]) + length)])

            for segments in by_key.values():
                if all(s[1] > 1 for s in segments):  # every string has a copy
                    for raw, _, uses in segments:
                        reply(uses, [(0, len(raw))])
                    continue
                held += segments
                size += sum(len(s[0]) for s in segments)
                if size > SORT_BYTES:
                    sort_held()
                    held, size = [], 0
            if held:
                sort_held()
            return pa.table({"block": t.column("block").cast(pa.int32()), "at": t.column("at").cast(pa.int64()), "ranges": pa.array([_packed(np.array(r, "<u4").reshape(-1, 3)) for r in replies], pa.binary())})

        sent = self.docs.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(emit, "shard int, at long, keys binary, copies binary, sizes binary, bytes binary, block int")
        return sent.groupBy("shard").applyInArrow(search, "block int, at long, ranges binary")

    def cleaned(self) -> DataFrame:
        again = self.repeated_anchors()
        ranges = self.repeated_ranges(again)
        length, shares, shards = self.length, self.shares, self.shards
        # a block needs both: which of its anchors occur again (to number its segments), and the answers
        both = again.select("block", F.lit(0).alias("kind"), F.col("share").cast("long").alias("at"), F.col("at").alias("data")).unionByName(ranges.select("block", F.lit(1).alias("kind"), "at", F.col("ranges").alias("data")))

        def clean(texts: pa.Table, own: pa.Table) -> pa.Table:
            tidy()
            kind = own.column("kind").to_numpy()
            first_kind = own.filter(pa.array(kind == 0)).select(["at", "data"]).rename_columns(["share", "at"])
            t, data, off, first, _, order, uses = _segments(texts, first_kind, length, shares, shards)
            edge = np.zeros(len(data) + 1, np.int32)
            start, a, b = [], [], []
            by_number = np.argsort(uses, kind="stable")
            bounds = np.searchsorted(uses[by_number], np.arange(len(order) + 1))
            for at, raw in own.filter(pa.array(kind == 1)).select(["at", "data"]).to_pandas().itertuples(index=False):
                r = np.frombuffer(raw, "<u4").reshape(-1, 3).astype(np.int64)
                number = at + r[:, 0]
                n = bounds[number + 1] - bounds[number]
                which = np.repeat(bounds[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                start.append(first[by_number[which]])
                a.append(np.repeat(r[:, 1], n))
                b.append(np.repeat(r[:, 2], n))
            if start:
                s, a, b = (np.concatenate(x) for x in (start, a, b))
                np.add.at(edge, s + a, 1)
                np.add.at(edge, s + b, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept, n_removed, spans = [], [], []
            for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                g = gone[i:j]
                change = np.flatnonzero(np.diff(g, prepend=False, append=False)).reshape(-1, 2)
                n_removed.append(int((change[:, 1] - change[:, 0]).sum()))
                spans.append(change.tolist())
                kept.append(data[i:j][~g].tobytes() if len(change) else data[i:j].tobytes())
            return pa.table({"doc_id": t.column("doc_id"), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.binary())})

        return self.docs.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(clean, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept``: each text's UTF-8 bytes without those that a string of ``length``
    bytes covers that also starts anywhere else, in the same text or another; matches never cross documents.

    ``spans`` are the maximal removed runs (start, end exclusive), ``kept`` the bytes left. Null texts are empty;
    texts shorter than ``length`` keep all; rows that repeat an id or a text are documents of their own (so both lose
    what they share); a null id is an id like any other; other columns are ignored. An empty table gives no rows.
    """
    return SubstringDedup(docs, text, doc_id, length).cleaned()


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """What ``digests`` gives, by counting all strings: for tests."""
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out
