"""Ranked lexical search over a clustered index, exact.

Documents are reordered by recursive graph bisection, which puts documents with common terms next to each other: a
tree of bisections, fitted to a bounded sample, leads each document to a leaf; the rows are dealt to tasks by ranges of
leaves, and each task bisects what it gets on, down to clusters of CLUSTER documents. A cluster is a row of the index:
its postings, and of each term the greatest frequency and the shortest document, from which follows the most that any
of its documents can score.

A search visits the clusters with the greatest bounds of each query first. The score of the k-th document found there
is passed on to all others; a cluster whose bound is less has none of the k best, so leaving it out changes nothing.
Scores are integers; equal ones go by doc_id, whatever the order of the index.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, by_slices, new_path, sliced, text_buffer, tidy
from .runs import gathered

#: Documents of a cluster, and those that one bisection starts from at most (or so many bytes of terms).
CLUSTER, SHARD_DOCS, SHARD_BYTES = 256, 2048, 4 << 20
#: The tree: its levels, and the sample it is fitted to (documents, bytes of each, terms kept by document frequency).
LEVELS, SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TERMS = 6, 2_000, 16 << 10, 20_000
#: Rounds of exchanges at each level at most.
ROUNDS = 6
#: Text bytes of a task that builds clusters, about.
TASK_BYTES = 32 << 20
#: Clusters that a query visits first; words of a block of queries, about.
SEEDS, BLOCK_WORDS = 2, 400_000
#: Index rows that a Python worker gets at once.
ROWS_AT_ONCE = 32

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms_of(text: str | None) -> list[str]:
    """The terms of a text: ASCII letters and digits and all that is not ASCII; only A to Z are lower-cased."""
    return TERM.findall((text or "").translate(_SMALL))


#: Each byte's lower case, 0 for those between terms.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 0 for c in range(256))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impact(tf, size, n: int, words: int):  # noqa: ANN001, ANN201
    """What a term that occurs ``tf`` times adds for each unit of weight in a document of ``size`` terms; it grows
    with ``tf`` and falls with ``size``."""
    m = 75 + (25 * size * n) // max(words, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Counts:
    """Term frequencies of texts: ``terms[code[j]]`` occurs ``tf[j]`` times in the text ``j`` lies in."""

    terms: pa.Array
    code: np.ndarray
    tf: np.ndarray
    first: np.ndarray
    size: np.ndarray


def counts_of(texts: pa.Array) -> Counts:
    data, off = text_buffer(texts)
    data = np.frombuffer(data.tobytes().translate(_BYTES), np.uint8)
    inside = data != 0
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    cut = off[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut - 1] & inside[cut]]
    start, end = np.sort(np.concatenate([edge[::2], cut])), np.sort(np.concatenate([edge[1::2], cut]))
    size = np.diff(np.searchsorted(start, off, "left"))
    if not len(start):
        return Counts(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64), size)
    flat, at = gathered(data, start, end, np.zeros(len(start), bool))
    coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)).dictionary_encode()
    many = len(coded.dictionary)
    key, tf = np.unique(np.repeat(np.arange(len(size)), size) * many + np.asarray(coded.indices), return_counts=True)
    return Counts(coded.dictionary, key % many, tf, np.searchsorted(key, np.arange(len(size) + 1) * many), size)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``; empty stretches are 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def bisect(code: np.ndarray, first: np.ndarray, least: int, levels: int | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """An order of documents (``code[first[i]:first[i + 1]]``: the different terms of document ``i``) by recursive graph
    bisection, parts of at most ``least`` left as they are; and of each level the bounds of its parts and, for each part
    and term, the documents in its left and right half that hold it.

    Each half is a part of the next level. Pairs of documents are exchanged while that shortens the gaps between the
    documents of each term: a term in d of n documents costs d * log2(n / (d + 1)).
    """
    docs, terms = len(first) - 1, int(code.max()) + 1 if len(code) else 1
    order, parts, seen = np.arange(docs), [(0, docs)], []
    doc_of = np.repeat(np.arange(docs), np.diff(first))
    while levels is None and max(b - a for a, b in parts) > least or levels is not None and len(seen) < levels:
        middle = [(a + b + 1) // 2 for a, b in parts]
        part, right, place = np.zeros(docs, np.int64), np.zeros(docs, bool), np.zeros(docs, np.int64)
        place[order] = np.arange(docs)
        for k, ((a, b), m) in enumerate(zip(parts, middle, strict=True)):
            part[order[a:b]], right[order[m:b]] = k, True
        key = part[doc_of] * terms + code
        n = np.array([[m - a, b - m] for (a, b), m in zip(parts, middle, strict=True)], np.float64).repeat(terms, 0)
        cost = lambda d, n: d * np.log2(np.maximum(n, 1) / (d + 1))
        for _ in range(ROUNDS):
            there = right[doc_of]
            in_right = np.bincount(key[there], minlength=len(n)).astype(np.float64)
            in_left = np.bincount(key[~there], minlength=len(n)).astype(np.float64)
            now = cost(in_left, n[:, 0]) + cost(in_right, n[:, 1])
            gain_left = now - cost(np.maximum(in_left - 1, 0), n[:, 0]) - cost(in_right + 1, n[:, 1])
            gain_right = now - cost(in_left + 1, n[:, 0]) - cost(np.maximum(in_right - 1, 0), n[:, 1])
            gain = _sums(np.where(there, gain_right[key], gain_left[key]), first)
            moved = 0
            for (a, b), m in zip(parts, middle, strict=True):
                lefts, rights = order[a:m], order[m:b]
                lefts, rights = lefts[np.argsort(-gain[lefts], kind="stable")], rights[np.argsort(-gain[rights], kind="stable")]
                pairs = min(len(lefts), len(rights))
                swap = int((gain[lefts[:pairs]] + gain[rights[:pairs]] > 1e-9).sum())  # falling, so the first ones
                order[a:b] = np.concatenate([rights[:swap], lefts[swap:], lefts[:swap], rights[swap:]])
                right[lefts[:swap]], right[rights[:swap]] = True, False
                moved += swap
            if not moved:
                break
        there = right[doc_of]
        seen.append((np.array([[m - a, b - m] for (a, b), m in zip(parts, middle, strict=True)]), np.stack([np.bincount(key[~there], minlength=len(n)), np.bincount(key[there], minlength=len(n))], 1).reshape(len(parts), terms, 2)))
        parts = [x for (a, b), m in zip(parts, middle, strict=True) for x in ((a, m), (m, b))]
    return order, seen


@dataclass
class Tree:
    """``pull[level][node, term]``: by how much a term draws a document to the left half of a node."""

    terms: pa.Array
    pull: list[np.ndarray]

    def leaves(self, counts: Counts) -> np.ndarray:
        docs = len(counts.first) - 1
        leaf = np.zeros(docs, np.int64)
        if not self.pull:
            return leaf
        known = np.asarray(pc.fill_null(pc.index_in(counts.terms, self.terms), -1)).astype(np.int64)[counts.code]
        doc_of = np.repeat(np.arange(docs), np.diff(counts.first))[known >= 0]
        known = known[known >= 0]
        for pull in self.pull:
            toward = np.bincount(doc_of, pull[leaf[doc_of], known], minlength=docs)
            leaf = 2 * leaf + (toward < 0)
        return leaf


def fit_tree(docs: DataFrame, text: str = "text") -> Tree:
    """The bisections of a sample of at most SAMPLE_DOCS documents of at most SAMPLE_BYTES bytes."""
    sample = docs.select(F.col(text).alias("text")).filter(F.octet_length("text").between(1, SAMPLE_BYTES)).limit(SAMPLE_DOCS).toArrow()
    counts = counts_of(sample.column("text").combine_chunks()) if sample.num_rows else None
    if counts is None or not len(counts.code):
        return Tree(pa.array([], pa.large_string()), [])
    df = np.bincount(counts.code, minlength=len(counts.terms))
    kept = np.argsort(-df, kind="stable")[:SAMPLE_TERMS]
    kept = kept[df[kept] > 1]
    number = np.full(len(df), -1)
    number[kept] = np.arange(len(kept))
    code = number[counts.code]
    first = np.concatenate([[0], np.cumsum(code >= 0)])[counts.first]
    code = code[code >= 0]
    if not len(code):
        return Tree(pa.array([], pa.large_string()), [])
    levels = min(LEVELS, max(0, (len(first) - 1).bit_length() - 3))
    _, seen = bisect(code, first, 1, levels)
    pull = [np.log2((held[:, :, 0] + 1) / (n[:, None, 0] + 2)) - np.log2((held[:, :, 1] + 1) / (n[:, None, 1] + 2)) for n, held in seen]
    return Tree(counts.terms.take(pa.array(kept)), [p.astype(np.float32) for p in pull])


def _put_in_leaves(rows: DataFrame, tree) -> DataFrame:  # noqa: ANN001
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counts_of(batch.column(1))
        data, off = text_buffer(c.terms)
        gap = np.ones(len(c.code), bool)
        gap[c.first[1:][np.diff(c.first) > 0] - 1] = False
        flat, at = gathered(data, off[:-1][c.code], off[1:][c.code], gap)
        words = pa.LargeStringArray.from_buffers(len(c.size), pa.py_buffer(at[c.first].astype(np.int64)), pa.py_buffer(flat))
        tf = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(c.size), [None, pa.py_buffer((4 * c.first).astype(np.int64)), pa.py_buffer(c.tf.astype("<u4"))])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.size), pa.array(tree.value.leaves(c), pa.int32()), words.cast(pa.string()), tf.cast(pa.binary())], ["doc_id", "size", "leaf", "terms", "tf"])

    return rows.mapInArrow(by_slices(each, "text"), "doc_id long, size long, leaf int, terms string, tf binary")


INDEX = "cluster long, doc_ids array<long>, sizes binary, found long, words long, terms string, df binary, most_tf binary, least_size binary, places binary, tfs binary"


def _shard(tables: list[pa.RecordBatch], cluster: int, most_docs: int) -> pa.RecordBatch:
    """The clusters of some documents, numbered from ``cluster``."""
    rows = pa.Table.from_batches(tables).combine_chunks()
    ids = rows.column("doc_id").combine_chunks()
    size = rows.column("size").to_numpy()
    raw, off = _binary(rows.column("tf"))
    tf, first = np.frombuffer(raw, "<u4").astype(np.int64), off // 4
    words = pc.split_pattern(rows.column("terms").combine_chunks().cast(pa.large_string()), " ").flatten()
    coded = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
    code, terms, docs = np.asarray(coded.indices).astype(np.int64), max(1, len(coded.dictionary)), len(size)
    df = np.bincount(code, minlength=terms)
    telling = (df > 1) & (df < docs)  # the others cost the same wherever they are
    number = np.cumsum(telling) - 1
    order, _ = bisect(number[code[telling[code]]], np.concatenate([[0], np.cumsum(telling[code])])[first], most_docs)
    place = np.zeros(docs, np.int64)
    place[order] = np.arange(docs)
    doc_of = np.repeat(np.arange(docs), np.diff(first))
    key = (place[doc_of] // most_docs * terms + code) * most_docs + place[doc_of] % most_docs
    by = np.argsort(key, kind="stable")
    key, tf, doc_of = key[by], tf[by], doc_of[by]
    group = key // most_docs
    begin = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.zeros(0, np.int64)
    many = np.diff(np.append(begin, len(group)))
    most_of = np.maximum.reduceat(tf, begin) if len(begin) else tf
    least = np.minimum.reduceat(size[doc_of], begin) if len(begin) else size[:0]
    clusters = -(-docs // most_docs)
    owned = np.searchsorted(group[begin] // terms, np.arange(clusters + 1))
    posted = np.append(begin, len(group))[owned]
    out: dict[str, list] = {f.split()[0]: [] for f in INDEX.split(", ")}
    for c in range(clusters):
        own, mine, post = order[c * most_docs : (c + 1) * most_docs], slice(owned[c], owned[c + 1]), slice(posted[c], posted[c + 1])
        vocabulary = coded.dictionary.take(pa.array(group[begin[mine]] % terms)).to_pylist()
        for name, value in (
            ("cluster", cluster + c), ("doc_ids", ids.take(pa.array(own)).to_pylist()), ("sizes", size[own].astype("<i8").tobytes()), ("found", int((size[own] > 0).sum())), ("words", int(size[own].sum())),
            ("terms", " ".join(vocabulary)), ("df", many[mine].astype("<u2").tobytes()), ("most_tf", most_of[mine].astype("<u4").tobytes()), ("least_size", least[mine].astype("<u4").tobytes()),
            ("places", (key[post] % most_docs).astype(np.uint8).tobytes()), ("tfs", tf[post].astype("<u4").tobytes()),
        ):
            out[name].append(value)
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([("cluster", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("found", pa.int64()), ("words", pa.int64()), ("terms", pa.string()), *((n, pa.binary()) for n in ("df", "most_tf", "least_size", "places", "tfs"))]))


def _binary(column: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    a = column.combine_chunks().cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    return (a.buffers()[2].to_pybytes() if a.buffers()[2] else b"")[off[0] : off[-1]], off - off[0]


def _clusters(most_docs: int, shard_docs: int):  # noqa: ANN202
    """A function for ``mapInArrow`` that makes clusters of what a task gets, shard after shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, docs, size = [], 0, 0
        for batch in batches:
            for part in sliced(batch, "terms"):
                i = 0
                while i < part.num_rows:
                    piece = part.slice(i, shard_docs - docs)
                    held.append(piece)
                    i, docs, size = i + piece.num_rows, docs + piece.num_rows, size + piece.nbytes
                    if docs >= shard_docs or size >= SHARD_BYTES:
                        yield (out := _shard(held, number, most_docs))
                        number, held, docs, size = number + out.num_rows, [], 0, 0
                        tidy()
        if held:
            yield _shard(held, number, most_docs)

    return run


def build_index(docs: DataFrame, path: str, cluster: int = CLUSTER, shard: int = SHARD_DOCS, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes the index of all rows of ``docs`` under ``path``: clusters of at most ``cluster`` (256 or less) documents,
    made of ``shard`` at a time.

    A row without terms (null, empty, signs only) is in it but is never found; repeated rows and ids are documents of
    their own; other columns are ignored. Rows are dealt by ranges of (leaf, place in the input), so that a leaf with
    very many documents, copies of one text as well, goes to as many tasks as it needs.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tree = spark.sparkContext.broadcast(fit_tree(rows))
    dealt = _put_in_leaves(rows, tree).withColumn("_at", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(max(1, -(-size // TASK_BYTES)), "leaf", "_at").sortWithinPartitions("leaf", "_at")
    dealt.select("doc_id", "size", "terms", "tf").mapInArrow(_clusters(cluster, shard), INDEX).write.parquet(path)


@dataclass
class Queries:
    """A block of queries: ``terms`` (all different), and of query ``i`` the terms and how often it has each."""

    keys: list
    terms: pa.Array
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray
    weights: np.ndarray | None = None
    n: int = 0
    words: int = 0
    least: np.ndarray | None = None

    @classmethod
    def of(cls, items: list[tuple]) -> Queries:
        counted = [Counter(terms_of(t)) for _, t in items]
        number = {t: i for i, t in enumerate(dict.fromkeys(t for c in counted for t in c))}
        flat = [(number[t], k) for c in counted for t, k in c.items()]
        term, times = np.array(flat, np.int64).reshape(-1, 2).T
        return cls([k for k, _ in items], pa.array(list(number), pa.large_string()), np.concatenate([[0], np.cumsum([len(c) for c in counted])]).astype(np.int64), term, times)

    def matched(self, batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each cluster: which of its terms are asked for, and their numbers here."""
        lists = pc.split_pattern(batch.column("terms").cast(pa.large_string()), " ")
        at = np.asarray(lists.offsets)
        found = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), self.terms), -1)).astype(np.int64)
        return [((own := np.flatnonzero(found[a:b] >= 0)), found[a:b][own]) for a, b in zip(at - at[0], at[1:] - at[0], strict=False)]

    def bounds(self, batch: pa.RecordBatch, row: int, own: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The most that any document of a cluster can score for each query."""
        most = np.frombuffer(batch.column("most_tf")[row].as_py(), "<u4").astype(np.int64)[own]
        least = np.frombuffer(batch.column("least_size")[row].as_py(), "<u4").astype(np.int64)[own]
        high = np.zeros(len(self.terms), np.int64)
        high[asked] = impact(most, least, self.n, self.words)
        return _sums(self.weights * high[self.term], self.first)


def _document_frequencies(index: DataFrame, asked) -> DataFrame:  # noqa: ANN001
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = asked.value
        df = np.zeros(len(q.terms), np.int64)
        for batch in batches:
            for row, (own, numbers) in enumerate(q.matched(batch)):
                df[numbers] += np.frombuffer(batch.column("df")[row].as_py(), "<u2")[own]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    return index.select("terms", "df").mapInArrow(each, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _first_clusters(index: DataFrame, asked) -> DataFrame:  # noqa: ANN001
    """``query, cluster, bound``: the SEEDS clusters of each query with the greatest bounds."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = asked.value
        best = np.zeros((SEEDS, len(q.keys)), np.int64)
        where = np.full((SEEDS, len(q.keys)), -1, np.int64)
        for batch in batches:
            for row, (own, numbers) in enumerate(q.matched(batch)):
                bound, cluster = q.bounds(batch, row, own, numbers), np.full(len(q.keys), batch.column("cluster")[row].as_py())
                for k in range(SEEDS):  # one insertion into each query's short list
                    up = bound > best[k]
                    best[k], bound = np.where(up, bound, best[k]), np.where(up, best[k], bound)
                    where[k], cluster = np.where(up, cluster, where[k]), np.where(up, where[k], cluster)
        k, query = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(where[k, query]), pa.array(best[k, query])], ["query", "cluster", "bound"])

    found = index.select("cluster", "terms", "most_tf", "least_size").mapInArrow(each, "query long, cluster long, bound long")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "cluster"))).filter(F.col("_n") <= SEEDS)


def _scores(index: DataFrame, asked, k: int) -> DataFrame:  # noqa: ANN001
    """``query, doc_id, score``: what may be among the k best of each query, at most k rows of each task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = asked.value
        least = q.least.copy()
        best: dict[int, list[tuple]] = {}  # of each query (-score, id is null, id), the best first
        for batch in batches:
            matched = q.matched(batch)
            bounds = [q.bounds(batch, row, *m) for row, m in enumerate(matched)]
            for row in sorted(range(len(bounds)), key=lambda r: -int(bounds[r].max(initial=0))):
                visited = np.flatnonzero((bounds[row] > 0) & (bounds[row] >= least))
                if len(visited):
                    _visit(q, batch, row, *matched[row], visited.tolist(), best, least, k)
        rows = [(query, None if null else doc, -score) for query, found in best.items() for score, null, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], ["query", "doc_id", "score"])

    columns = ("cluster", "doc_ids", "sizes", "terms", "df", "most_tf", "least_size", "places", "tfs")
    return index.select(*columns).mapInArrow(each, "query long, doc_id long, score long")


def _visit(q: Queries, batch: pa.RecordBatch, row: int, own: np.ndarray, asked: np.ndarray, visited: list[int], best: dict, least: np.ndarray, k: int) -> None:
    """Scores a cluster's documents for the queries that visit it; ``best`` and ``least`` are kept up to date."""
    get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py(), kind).astype(np.int64)
    df, sizes, places, tfs = get("df", "<u2"), get("sizes", "<i8"), get("places", np.uint8), get("tfs", "<u4")
    end = np.cumsum(df)
    many = df[own]
    at = np.repeat(end[own] - many - (np.cumsum(many) - many), many) + np.arange(many.sum())
    impacts = np.zeros((len(own) + 1, len(sizes)), np.int64)  # the last row is for terms that the cluster has not
    impacts[np.repeat(np.arange(len(own)), many), places[at]] = impact(tfs[at], sizes[places[at]], q.n, q.words)
    line = np.full(len(q.terms), len(own))
    line[asked] = np.arange(len(own))
    ids = None
    for i in visited:
        mine = slice(q.first[i], q.first[i + 1])
        lines = line[q.term[mine]]
        there = lines < len(own)
        score = q.weights[mine][there] @ impacts[lines[there]]
        hits = np.flatnonzero((score > 0) & (score >= least[i]))
        if len(hits):
            ids = batch.column("doc_ids")[row].as_py() if ids is None else ids
            best[i] = found = sorted([*best.get(i, ()), *((-int(score[h]), ids[h] is None, ids[h] or 0) for h in hits.tolist())])[:k]
            if len(found) == k:
                least[i] = max(least[i], -found[-1][0])


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    block, words = [], 0
    for key, body in items.toLocalIterator():
        block.append((key, body))
        words += len(body or "") // 6
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def search_index(spark: SparkSession, path: str, items: DataFrame, k: int = 20, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: of each row of ``items`` the k documents of the index under ``path`` with the
    greatest scores above 0, equal ones by doc_id (null last).

    A document's score is the sum, over the query's terms with their repeats, of the term's weight times its impact. A
    query without terms, or with terms that no document has, gives no rows; rows that repeat an item_id are queries of
    their own. Queries go to the tasks in blocks of about BLOCK_WORDS words.
    """
    bounded_batches(spark, ROWS_AT_ONCE)
    index = spark.read.schema(INDEX).parquet(path)
    n, words = index.agg(F.sum("found"), F.sum("words")).first()
    send = spark.sparkContext.broadcast
    out = spark.createDataFrame([], f"item_id {dict(items.dtypes)[item_id]}, rank int, doc_id long, score long")
    for block in _blocks(items.select(item_id, text)):
        q = Queries.of(block)
        q.n, q.words = n or 0, words or 0
        df = dict(_document_frequencies(index, send(q)).collect())  # of the block's terms
        q.weights = np.array([weight(q.n, df[t]) * m if t in df else 0 for t, m in zip(q.term.tolist(), q.times.tolist(), strict=True)], np.int64)
        q.least = np.zeros(len(block), np.int64)
        asked = send(q)
        first = _first_clusters(index, asked).select("cluster").distinct()  # SEEDS of each query at most
        seeds = _top(_scores(index.join(F.broadcast(first), "cluster", "left_semi"), asked, k), k)
        for query, score in seeds.filter(F.col("rank") == k).select("query", "score").collect():
            q.least[query] = score
        final = _top(_scores(index, send(q), k), k)
        keys = spark.createDataFrame([(i, key) for i, key in enumerate(q.keys)], f"query long, item_id {dict(items.dtypes)[item_id]}")
        out = out.unionByName(final.join(F.broadcast(keys), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, cluster: int = CLUSTER, shard: int = SHARD_DOCS) -> DataFrame:
    """``search_index`` over an index of ``docs`` in the shared folder."""
    path = new_path(docs.sparkSession, "clustered-index")
    build_index(docs, path, cluster, shard)
    return search_index(docs.sparkSession, path, items, k)
