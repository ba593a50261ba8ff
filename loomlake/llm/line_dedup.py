"""Line dedup by a log-template tree.

A line's tokens are its runs between white space; one with a digit is a variable field from the start. The tree has a
fixed depth: the token count, then the leading tokens. Within a leaf the first line left, in the order of their hashes,
starts a template; each further line that agrees with it in a share of its places joins, and the places in which it
differs become variable fields, which the next line need not match and which don't count as agreeing. A leaf's lines
are first merged in PARTS parts, dealt by their hashes at every size, and then the templates of the parts, so that one
leaf that holds a great part of all lines is the work of many tasks. A template that recurs in MIN_TEXTS different
texts, or in LONG_TEXTS if it has LONG_LINE tokens, which don't recur by chance, is dropped from all documents but the
first that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_slices, release, shuffle_partitions, with_fields, written

#: Leading tokens that the tree looks at, share of a line's places that agree with its template, different texts in
#: which a template recurs, and the share of its tokens that a document must keep to stay.
DEPTH, AGREE, MIN_TEXTS, MIN_KEPT = 4, 0.8, 10, 0.0
#: Tokens of a line that is a passage, and different texts in which such a one recurs.
LONG_LINE, LONG_TEXTS = 20, 2
#: Parts of a leaf that are merged on their own first; different lines that are compared without bands of places, which
#: only look up what to compare.
PARTS, LEAF = 256, 4096
#: Stands for a variable field that merging made.
MERGED = 0

FIELD = b"<*>"
_DIGITS = frozenset(b"0123456789")


def line_tokens(line: str) -> list[bytes]:
    """Tokens of a line, variable fields masked; white space is that of ``bytes.split``."""
    return [FIELD if not _DIGITS.isdisjoint(t) else t for t in line.encode("utf-8", "surrogatepass").split()]


def _hash(tokens: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(tokens), digest_size=8).digest(), "little", signed=True)


def _leaf(tokens: list[bytes], depth: int) -> int:
    return _hash([str(len(tokens)).encode(), *tokens[:depth]])


def line_hashes(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc_id, text_hash, line, leaf, line_hash, n``: the lines with tokens of every text."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, lines, leaves, hashes, counts = [], [], [], [], [], []
        for d, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not text:
                continue
            for k, line in enumerate(text.split("\n")):
                if tokens := line_tokens(line):
                    ids.append(d)
                    texts.append(own)
                    lines.append(k)
                    leaves.append(_leaf(tokens, depth))
                    hashes.append(_hash(tokens))
                    counts.append(len(tokens))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, texts, lines, leaves, hashes, counts)], ["doc_id", "text_hash", "line", "leaf", "line_hash", "n"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(by_slices(f, "text"), "doc_id long, text_hash long, line long, leaf long, line_hash long, n long")


def _merged(tokens: np.ndarray, at: np.ndarray, first: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the lines ``at``, in their order, that join the template that line ``first`` starts, and the template."""
    same = (tokens[at] == tokens[first]) & (tokens[first] != MERGED)
    at, same = at[keep := same.sum(axis=1) >= least], same[keep]
    # lines that differ in the same places fare alike, so each such set is tried once, in the order of its first line
    _, place, own = np.unique(np.packbits(same, axis=1), axis=0, return_index=True, return_inverse=True)
    constant, joins = tokens[first] != MERGED, np.zeros(len(place), bool)
    for k in np.argsort(place):
        now = constant & same[place[k]]
        if now.sum() >= least:
            constant, joins[k] = now, True
    return at[joins[own.reshape(-1)]], np.where(constant, tokens[first], MERGED)


def templates(tokens: np.ndarray, agree: float = AGREE) -> tuple[np.ndarray, np.ndarray]:
    """(group of each line, tokens of each group's template) of one leaf: a matrix of token hashes, MERGED at variable
    fields. A line that has more of them than may differ is a template of its own."""
    n, width = tokens.shape
    least = int(np.flatnonzero(np.arange(width + 1) / max(1, width) >= agree)[0])
    group, found = np.full(n, -1), []

    def start(r: int, near: np.ndarray) -> None:
        at, own = _merged(tokens, near, r, least)
        group[at] = group[r] = len(found)
        found.append(own if len(at) else tokens[r])

    if n <= LEAF:
        rows = np.arange(n)
        while len(rows):
            start(rows[0], rows)
            rows = rows[group[rows] < 0]
        return group, np.stack(found)
    # lines that agree differ in fewer places than there are bands of places, so they share a band
    bands = width - least + 1
    values = np.array([len(np.unique(tokens[:, k])) for k in range(width)])
    places = np.argsort(-values, kind="stable")
    of, members, starts, ends = [], [], [], []
    for b in range(bands):
        key = np.zeros(n, np.uint64)
        for k in places[b::bands]:
            key = key * np.uint64(0x9E3779B97F4A7C15) + tokens[:, k].astype(np.uint64)
        _, own, count = np.unique(key, return_inverse=True, return_counts=True)
        of.append(own)
        members.append(np.argsort(own, kind="stable"))
        ends.append(np.cumsum(count))
        starts.append(ends[b] - count)
    for r in range(n):
        if group[r] >= 0:
            continue
        near = []
        for own, m, s, e in zip(of, members, starts, ends, strict=True):
            i = own[r]
            left = m[s[i] : e[i]]
            left = left[group[left] < 0]
            m[s[i] : s[i] + len(left)] = left  # lines that have a group aren't looked at again
            e[i] = s[i] + len(left)
            near.append(left)
        start(r, np.unique(np.concatenate(near)))
    return group, np.stack(found)


def _parsed(tokens: DataFrame, keys: list[str], agree: float) -> DataFrame:
    """``leaf, line_hash, template, tokens``: the lines (``leaf, part, line_hash, tokens``) that agree in ``keys`` are
    merged; a template's name is its least line hash, and that line has the template's tokens, the others null."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .near_dedup import _groups

        for t in _groups(batches, len(keys)):
            own = t.column("line_hash").to_numpy()
            own, first = np.unique(own, return_index=True)  # in the order of their hashes
            raw = t.column("tokens")
            matrix = np.stack([np.frombuffer(raw[int(i)].as_buffer(), "<u4") for i in first])
            group, found = templates(matrix, agree)
            _, head = np.unique(group, return_index=True)
            heads = np.zeros(len(own), bool)
            heads[head] = True
            blob = [found[g].tobytes() if h else None for g, h in zip(group, heads, strict=True)]
            leaf = np.full(len(own), t.column("leaf")[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(own), pa.array(own[head[group]]), pa.array(blob, pa.binary())], ["leaf", "line_hash", "template", "tokens"])

    n = shuffle_partitions(tokens.sparkSession)
    dealt = tokens.select(*keys, *(c for c in ("line_hash", "tokens"))).repartition(n, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(parse, "leaf long, line_hash long, template long, tokens binary")


def recurring(docs: DataFrame, depth: int = DEPTH, agree: float = AGREE, min_texts: int = MIN_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(lines, templates): the hashed lines of ``line_hashes``, and ``line_hash, first, n_texts`` of each line whose
    template recurs; ``first`` is the row that has it first: whether its id is null, its id, the hash of its text."""
    spark = docs.sparkSession
    needed = F.when(F.col("n") >= LONG_LINE, F.lit(min(min_texts, LONG_TEXTS))).otherwise(F.lit(min_texts))
    lines = written(line_hashes(docs, depth), "line-hashes")
    row = [F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash")]
    # counted over different texts, so that copies of a document don't make its lines boilerplate
    leaves = lines.select("leaf", "n", "text_hash").distinct().groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= needed).select("leaf", "n")
    distinct = lines.groupBy("leaf", "line_hash", "n").agg(F.min(F.struct(*row, "line")).alias("at"))
    wanted = distinct.join(leaves, ["leaf", "n"]).select("leaf", "line_hash", "n", F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash"), F.col("at.line").alias("line"))
    wanted = written(wanted, "line-wanted")
    # short lines are their own leaf: no tokens are needed where a leaf holds one line
    several = wanted.groupBy("leaf").agg(F.count(F.lit(1)).alias("k"))
    wanted = wanted.join(several, "leaf")
    fetch = wanted.filter("k > 1").groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set("line").alias("lines"))

    def tokens_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaf, own, raw = [], [], []
        for text, lines_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = (text or "").split("\n")
            for k in lines_:
                tokens = line_tokens(parts[k])
                leaf.append(_leaf(tokens, depth))
                own.append(_hash(tokens))
                raw.append(np.array([hash_token(t) for t in tokens], "<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(own, pa.int64()), pa.array(raw, pa.binary())], ["leaf", "line_hash", "tokens"])

    same_row = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h"))
    tokens = docs.select("doc_id", "text").join(fetch, same_row).select("text", "lines").mapInArrow(by_slices(tokens_of, "text"), "leaf long, line_hash long, tokens binary")
    parts = written(_parsed(tokens.withColumn("part", F.pmod("line_hash", F.lit(PARTS))), ["leaf", "part"], agree), "line-parts")
    whole = _parsed(parts.filter("tokens is not null"), ["leaf"], agree).select("leaf", F.col("line_hash").alias("part"), "template")
    parsed = parts.select("leaf", "line_hash", F.col("template").alias("part")).join(whole, ["leaf", "part"]).select("leaf", "line_hash", "template")
    single = wanted.filter("k = 1").select("leaf", "line_hash", F.col("line_hash").alias("template"))
    found = written(parsed.unionByName(single), "line-templates")
    release(spark)
    seen = lines.select("leaf", "line_hash", "text_hash", "doc_id", "n").join(found, ["leaf", "line_hash"])
    per_text = seen.groupBy("leaf", "template", "text_hash").agg(F.min(F.struct(*row)).alias("first"), F.max("n").alias("n"))
    often = per_text.groupBy("leaf", "template").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n_texts"), F.max("n").alias("n")).filter(F.col("n_texts") >= needed)
    return lines, found.join(often, ["leaf", "template"]).select("line_hash", "first", "n_texts")


def hash_token(token: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(token, digest_size=4).digest(), "little") or 1


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH, agree: float = AGREE, min_texts: int = MIN_TEXTS, min_kept: float = MIN_KEPT, spare: bool = False) -> DataFrame:
    """``docs`` (all its columns, ``text`` without the dropped lines) plus ``n_lines, n_dropped, kept``.

    ``kept`` is false where lines were dropped and less than ``min_kept`` of the document's tokens is left, or none.
    Lines part at ``\\n``; lines without tokens are never dropped. Null and empty texts stay as they are (no lines
    dropped). Rows that share an id are rows of their own, told apart by their texts; rows that are equal in id and text
    keep or lose the same lines; a null id comes after all others. Columns of ``docs`` named like the new ones are
    replaced. An empty table gives no rows.

    With ``spare``, a document that would have nothing left, such as a copy, keeps the lines that recur in fewer than
    ``min_texts`` texts: what comes later decides over whole documents.
    """
    new = ("n_lines", "n_dropped", "kept")
    base = docs.drop(*new)
    bounded_batches(docs.sparkSession)
    lines, often = recurring(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), depth, agree, min_texts)
    often = often.select("line_hash", "first", (F.col("n_texts") >= min_texts).alias("common"))
    mark = "_"
    while any(c.lower().startswith(mark + "cut_") for c in base.columns):
        mark += "_"
    gone, common, d, h = (f"{mark}cut_{x}" for x in ("lines", "common", "doc", "hash"))
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    cuts = lines.join(often, "line_hash").filter(~first).groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).agg(F.collect_set("line").alias(gone), F.collect_set(F.when(F.col("common"), F.col("line"))).alias(common))
    joined = base.join(cuts, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(h)), "left").drop(d, h)
    names = [*base.columns, *new]
    at = names.index(text)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, n_lines, n_dropped, kept = [], [], [], []
        for body, gone_, common in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            parts = body.split("\n") if body else []
            n_lines.append(len(parts))
            drop = {k for k in gone_ or () if k < len(parts)}
            if spare and drop and not any(x.strip() for k, x in enumerate(parts) if k not in drop):
                drop = {k for k in common if k < len(parts)}
            n_dropped.append(len(drop))
            if drop:
                left = [x for k, x in enumerate(parts) if k not in drop]
                body_left = "\n".join(left)
                kept.append(len(body_left.split()) >= min_kept * len(body.split()) and bool(body_left.strip()))
                body = body_left
            else:
                kept.append(True)
            out.append(body)
        columns = [pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 2)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.bool_())], names)

    return joined.mapInArrow(by_slices(cut, text), with_fields(base.schema, n_lines="long", n_dropped="long", kept="boolean"))
