"""Token counts of whole texts under a sentence-piece model, without a shuffle: a two-tier lookup of pre-token lengths.

A text is cut where two neighbouring characters stand together in no piece of the model (before a run of blanks, and
between most signs): nothing is ever merged across such a place, so its count is the sum of its pre-tokens' counts.
Those of frequent pre-tokens come from a compact hash table that is built once, from a bounded sample, and broadcast;
a miss is encoded by the library and kept in a cache of the worker. The sample and the caches decide on speed only.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_slices, text_buffer
from .words import mix

#: The frequent pre-tokens are counted over so many documents of at most so many bytes each; the table holds so many.
SAMPLE_DOCS, SAMPLE_BYTES, FREQUENT = 1_000, 16 << 10, 50_000
#: Pre-tokens that a worker remembers, twice (those met since the last turn, and those of the turn before), each of at
#: most so many bytes.
CACHED, CACHED_BYTES = 300_000, 64
#: Longer pre-tokens are cut between any two characters that stand together in no piece.
LONG = 512

_BLANK_MARK = "▁"
_rng = np.random.default_rng(20240713)
_BYTE = _rng.integers(1, 1 << 64, 256, np.uint64) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.multiply.accumulate(np.full(CACHED_BYTES, _STEP, np.uint64))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def hashes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, none longer than CACHED_BYTES or empty."""
    if len(off) < 2:
        return np.zeros(0, np.uint64)
    size = np.diff(off)
    place = np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], size)
    return mix(np.add.reduceat(_BYTE[data[off[0] : off[-1]]] * _POWERS[place], off[:-1] - off[0]))


class LengthTable:
    """Pre-tokens (at most CACHED_BYTES bytes) and their counts: open addressing, the bytes one after the other.

    A hash only tells where to look: what is found there is compared byte by byte.
    """

    def __init__(self, words: pa.Array, counts: np.ndarray):
        self.data, self.off = text_buffer(words)
        self.counts = counts.astype(np.uint16)
        size = 1 << max(4, (2 * len(counts)).bit_length())
        self.slots = np.zeros(size, np.int32)  # 0: free, else the word's number and one
        left, at = np.arange(len(counts)), hashes(self.data, self.off) & np.uint64(size - 1)
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free] + 1  # of several words at one place the last gets it
            own = self.slots[at] == left + 1
            left, at = left[~own], (at[~own] + np.uint64(1)) & np.uint64(size - 1)

    def find(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The count of each stretch of bytes, -1 where the table doesn't have it."""
        size = np.diff(off)
        out = np.full(len(size), -1, np.int64)
        left = np.flatnonzero((size > 0) & (size <= CACHED_BYTES))
        begin, n = off[:-1], size
        key = np.zeros(len(size), np.uint64)
        short, at_short = _stretches(data, begin[left], n[left])
        key[left] = hashes(short, at_short)
        at = key[left] & np.uint64(len(self.slots) - 1)
        while len(left):
            word = self.slots[at].astype(np.int64) - 1
            there = word >= 0
            left, at, word = left[there], at[there], word[there]
            same = np.diff(self.off)[word] == n[left]
            i, j = left[same], word[same]
            a, bounds = _stretches(data, begin[i], n[i])
            b, _ = _stretches(self.data, self.off[j], n[i])
            equal = np.add.reduceat((a != b).astype(np.int64), bounds[:-1]) == 0 if len(i) else np.zeros(0, bool)
            out[i[equal]] = self.counts[j[equal]]
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(same)[equal]] = False
            left, at = left[rest], (at[rest] + np.uint64(1)) & np.uint64(len(self.slots) - 1)
        return out


def _stretches(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(begin - off[:-1], size) + np.arange(off[-1])], off


class PieceCounter:
    """Counts of texts under one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        said = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            said.ParseFromString(f.read())
        norm, kinds = said.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        pieces = [p.piece.replace(_BLANK_MARK, " ") for p in said.pieces if p.type not in (kinds.CONTROL, kinds.BYTE, kinds.UNKNOWN)]
        pairs = {x for p in pieces for x in zip(p, p[1:], strict=False)}
        self.joined = np.zeros(128 * 128, bool)
        for a, b in pairs:
            if ord(a) < 128 and ord(b) < 128:
                self.joined[ord(a) * 128 + ord(b)] = True
        self.pairs = np.array(sorted(ord(a) << 21 | ord(b) for a, b in pairs), np.int64)
        # pieces are cut out of a text as they stand, a blank is put before it, none ends in a blank that has
        # something else before it, and a line feed, which no piece has, keeps that first blank off a pre-token
        plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        usual = said.trainer_spec.model_type == 2 and not said.trainer_spec.treat_whitespace_as_suffix and not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in said.pieces)
        self.by_parts = bool(plain and usual and all("\n" not in p for p in pieces) and not any(a != " " and b == " " for a, b in pairs))
        self.lead = len(self.model.encode("\n"))
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of all texts, and the place of each text's first (and the last's end)."""
        data, off = text_buffer(texts)
        if b"\xe2\x96\x81" in data.tobytes():  # the sign that stands for a blank is one
            data, off = text_buffer(pc.replace_substring(pc.fill_null(texts, ""), _BLANK_MARK, " "))
        begin = off[:-1][np.diff(off) > 0]
        spaced = np.insert(data, begin, 32)
        first = begin + np.arange(len(begin))
        left, right = spaced[:-1], spaced[1:]
        cut = (right == 32) & (left != 32)
        low = (left < 128) & (right < 128)
        cut |= low & ~self.joined[np.where(low, left, 0).astype(np.int64) * 128 + np.where(low, right, 0)]
        cut = np.concatenate([np.zeros(min(1, len(spaced)), bool), cut])
        cut[first] = True
        at = np.append(np.flatnonzero(cut), len(spaced))
        words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(spaced))
        return words, np.searchsorted(at, off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)]), "left")

    def _encoded(self, words: list[str]) -> list[int]:
        return [len(ids) - self.lead for ids in self.model.encode(["\n" + w for w in words], num_threads=1)]

    def _long(self, word: str) -> int:
        signs = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        pair = signs[:-1] << 21 | signs[1:]
        cut = np.flatnonzero(self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] != pair) + 1
        bounds = [0, *cut.tolist(), len(word)]
        parts = [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return sum(self._encoded(parts))

    def words(self, words: list[str]) -> list[int]:
        """The counts of pre-tokens: from the worker's cache, else encoded."""
        if len(self.known) > CACHED:
            self.known, self.before = {}, self.known
        out = [self.known.get(w, -1) for w in words]
        rest = []
        for i, n in enumerate(out):
            if n < 0:
                w = words[i]
                if (n := self.before.get(w, -1)) >= 0:
                    self.known[w] = out[i] = n
                elif len(w) > LONG:
                    out[i] = self._long(w)
                else:
                    rest.append(i)
        for i, n in zip(rest, self._encoded([words[i] for i in rest]), strict=True):
            out[i] = n
            if len(words[i]) <= CACHED_BYTES:
                self.known[words[i]] = n
        return out

    def count(self, texts: pa.Array, table: LengthTable | None = None) -> np.ndarray:
        if not self.by_parts:
            return np.array([len(ids) for ids in self.model.encode([t or "" for t in texts.to_pylist()], num_threads=1)], np.int64)
        words, first = self.parts(texts)
        if not len(words):
            return np.zeros(len(texts), np.int64)
        coded = words.dictionary_encode()
        data, off = text_buffer(coded.dictionary)
        found = table.find(data, off) if table is not None else np.full(len(off) - 1, -1, np.int64)
        if len(missed := np.flatnonzero(found < 0)):
            found[missed] = self.words(coded.dictionary.take(pa.array(missed)).to_pylist())
        total = np.concatenate([[0], np.cumsum(found[np.asarray(coded.indices)])])
        return total[first[1:]] - total[first[:-1]]


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One for each worker process and file."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def frequent_lengths(docs: DataFrame, path: str, text: str = "text") -> LengthTable | None:
    """The table of the most frequent pre-tokens of at most SAMPLE_DOCS documents of at most SAMPLE_BYTES bytes."""
    sample = docs.select(F.col(text).alias("text")).filter(F.octet_length("text").between(1, SAMPLE_BYTES)).limit(SAMPLE_DOCS).toArrow()
    if not sample.num_rows or not (own := counter(path)).by_parts:
        return None
    words, _ = own.parts(sample.column("text").combine_chunks())
    seen = pc.value_counts(words)
    seen = seen.filter(pc.less_equal(pc.binary_length(seen.field("values")), CACHED_BYTES))
    most = np.argsort(-np.asarray(seen.field("counts")), kind="stable")[:FREQUENT]
    kept = seen.field("values").take(pa.array(most))
    return LengthTable(kept, np.array(own.words(kept.to_pylist()), np.int64))


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, a row for each row of ``docs``: the UTF-8 bytes and the tokens of the
    whole text as the library gives them (no begin or end), and whether they are more than ``limit``.

    A null or empty text has 0 of both; repeated rows each count; a null doc_id is kept; other columns are ignored; an
    empty table gives no rows.
    """
    path = model or default_path()
    spark = docs.sparkSession
    bounded_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
        n = counter(path).count(batch.column(1), table.value)
        return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(by_slices(each, "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
