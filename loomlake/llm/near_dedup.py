"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF word shingles.

Each document is a weighted set of its shingles of five words; a shingle weighs its count in the document times an
inverse document frequency that is counted over all documents. Improved consistent weighted sampling gives K samples
of a set that agree between two sets with the probability of their weighted Jaccard similarity; bands of R samples
find candidates, and the exact weighted Jaccard similarity of the whole sets decides.

How it scales. Shingles never become rows: a block of documents sends its distinct shingle hashes, packed, to a fixed
share of the hash space, and gets back the frequency of those that other documents have too. Texts that are equal
word for word are one class from the start. Documents of one band are linked to the band's least document only, the
connected components of these links are gathered, and within a component every pair is compared exactly; a component
of more than MEMBERS documents or MEMBER_SHINGLES shingles is compared block by block, so that a task never holds more
than two blocks. Rows are told apart by their block and their place in its order, not by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, tidy, written
from .words import Words, mix

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** R) ** BANDS = 0.9998.
BANDS, R = 12, 3
#: Bytes of text that are one block, and of text whose shingle hashes go to one share.
BLOCK_BYTES, SHARE_BYTES = 4 << 20, 12 << 20
#: Documents of a component that one block holds, and their shingles, about (a longer text is a block of its own).
MEMBERS, MEMBER_SHINGLES = 3072, 1 << 20
#: Steps in which document frequencies are kept, for each doubling.
STEPS = 8

_rng = np.random.default_rng(7)
_TABLE = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of 2 ** 16 equal steps."""
    x = np.concatenate([np.linspace(0, 1, 20001) ** 2 * 2, np.linspace(2, 30, 20001)[1:]])
    return np.interp((np.arange(_TABLE) + 0.5) / _TABLE, 1 - np.exp(-x) * (1 + x), x)


_GAMMA = _gamma_quantiles()
_RATE, _LOG_C = _GAMMA.astype(np.float32), np.log(_GAMMA).astype(np.float32)
_SEEDS = _rng.integers(1, 1 << 64, BANDS * R, np.uint64) | np.uint64(1)


def weight_levels(level: np.ndarray, documents: int) -> np.ndarray:
    """The inverse document frequency for each level (STEPS times the base-2 logarithm of the frequency): 1.5 for a
    shingle of one document among many, 1 for one that every document has."""
    df = 2.0 ** (level / STEPS)
    return (1 + 0.5 * np.clip(np.log((documents + 1) / (df + 1)) / np.log(documents + 1), 0, 1)).astype(np.float32)


def frequency_level(df: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(STEPS * np.log2(df)), 255).astype(np.uint8)


def icws(shingles: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Samples, one row for each set; set ``i`` is ``first[i]:first[i + 1]``, none empty."""
    out = np.zeros((len(first) - 1, BANDS * R), np.uint64)
    log_w = np.log(weight)
    size = np.diff(first)
    for k, seed in enumerate(_SEEDS):
        x = mix(shingles ^ seed)
        r = _RATE[(x & np.uint64(0xFFFF)).astype(np.int64)]
        log_c = _LOG_C[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        beta = (x >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + beta)
        score = log_c - r * (t - beta) - r
        least = np.minimum.reduceat(score, first[:-1])
        hit = np.flatnonzero(score == np.repeat(least, size))
        # of equal scores (the tables are coarse), the least shingle counts
        own = np.searchsorted(first, hit, "right") - 1
        order = np.lexsort((shingles[hit], own))
        own, hit = own[order], hit[order]
        one = np.flatnonzero(np.diff(own, prepend=-1))
        hit = hit[one]
        out[:, k] = mix(shingles[hit] + mix(t[hit].astype(np.int64).astype(np.uint64) + seed))
    return out


def _sets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their counts, and where each text's begin."""
    h, text = words.shingles(SHINGLE)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(text[at], np.arange(len(words.first)))


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.diff(h, prepend=~h[:1]) != 0] if len(h) else h


def _share_of(h: np.ndarray, shares: int) -> np.ndarray:
    """A share's hashes lie between two bounds, so that ascending hashes have ascending shares."""
    return ((h >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _text_column(t: pa.Table) -> pa.Array:
    c = t.column("text")
    return pa.concat_arrays([x.cast(pa.large_string()) for x in c.chunks]) if c.num_chunks else pa.array([], pa.large_string())


def _ordered(t: pa.Table) -> pa.Table:
    """A block in the order that tells its rows apart: by id (nulls last), then text; rows equal in both may change
    places."""
    return t.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _nodes(t: pa.Table) -> np.ndarray:
    """A number for each row of an ordered block, different in all blocks."""
    return (t.column("block")[0].as_py() << 32) + np.arange(t.num_rows) if t.num_rows else np.zeros(0, np.int64)


def _weighted(words: Words, levels: pa.Table, shares: int, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, weights and bounds of each text of a block."""
    h, tf, first = _sets(words)
    all_ = _distinct(h)
    bounds = np.searchsorted(_share_of(all_, shares), np.arange(shares + 1))
    level = np.zeros(len(all_), np.uint8)
    for share, at, own in zip(levels.column("share").to_pylist(), levels.column("at"), levels.column("level"), strict=True):
        level[bounds[share] + np.frombuffer(at.as_buffer(), "<u4").astype(np.int64)] = np.frombuffer(own.as_buffer(), np.uint8)
    idf = weight_levels(np.arange(256), documents)
    return h, tf.astype(np.float32) * idf[level[np.searchsorted(all_, h)]], first


class NearDedup:
    """One run over ``docs`` (``doc_id``, ``text``; other columns are ignored)."""

    def __init__(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY):
        self.spark, self.similarity = docs.sparkSession, similarity
        size = docs.select(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
        self.documents = size["n"]
        self.blocks = max(1, round((size["b"] or 0) / BLOCK_BYTES), size["n"] >> 17)
        self.shares = max(4, round((size["b"] or 0) / SHARE_BYTES))
        # by id and text, so that rows without ids or under one id spread
        block = F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.col(text)), F.lit(self.blocks)).cast("int")
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), block.alias("block"))
        self.key = "_block"
        while self.key in docs.columns:
            self.key += "_"
        self.whole = docs.withColumn(self.key, block)
        self.text, self.doc_id = text, doc_id

    def frequencies(self) -> DataFrame:
        """``block, share, at, level``: of a block's distinct shingles (ascending, within a share) those that occur in
        more than one document, by place, with the level of their document frequency."""
        shares = self.shares

        def emit(t: pa.Table) -> pa.Table:
            tidy()
            h, _, first = _sets(Words(_text_column(t)))
            # the same shingle in several documents of the block: its hash goes once, with the number of documents
            h = np.sort(h)
            new = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(new, len(h)))
            h = h[new]
            bounds = np.searchsorted(_share_of(h, shares), np.arange(shares + 1))
            # 6 bytes tell the hashes of a share apart; its number is more bits of the hash
            low = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            many = count > 1
            place, number = np.arange(len(h)), count.astype("<u4")
            rows = [(s, low[a:b], (place[a:b] - a)[many[a:b]].astype("<u4"), number[a:b][many[a:b]]) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            return pa.table({"share": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([t.column("block")[0].as_py()] * len(rows), pa.int32()), "low": _binary([r[1] for r in rows]), "many": _binary([r[2] for r in rows]), "number": _binary([r[3] for r in rows])})

        def count(t: pa.Table) -> pa.Table:
            tidy()
            low, blocks, n = [], t.column("block").to_pylist(), []
            for raw, many, number in zip(t.column("low"), t.column("many"), t.column("number"), strict=True):
                b = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, 6)
                x = np.zeros((len(b), 8), np.uint8)
                x[:, :6] = b
                low.append(x.view("<u8").ravel())
                c = np.ones(len(b), np.int64)
                c[np.frombuffer(many.as_buffer(), "<u4")] = np.frombuffer(number.as_buffer(), "<u4")
                n.append(c)
            whole, numbers = np.concatenate(low), np.concatenate(n)
            order = np.argsort(whole, kind="stable")
            sorted_ = whole[order]
            new = np.flatnonzero(np.diff(sorted_, prepend=~sorted_[:1]) != 0)
            df = np.add.reduceat(numbers[order], new)
            back = np.empty(len(whole), np.uint8)
            back[order] = np.repeat(frequency_level(df), np.diff(np.append(new, len(whole))))
            at, levels, i = [], [], 0
            for x in low:
                own = back[i : i + len(x)]
                hit = np.flatnonzero(own)
                at.append(hit.astype("<u4"))
                levels.append(own[hit])
                i += len(x)
            return pa.table({"block": pa.array(blocks, pa.int32()), "share": t.column("share").cast(pa.int32()), "at": _binary(at), "level": _binary(levels)})

        sent = self.docs.groupBy("block").applyInArrow(emit, "share int, block int, low binary, many binary, number binary")
        return sent.groupBy("share").applyInArrow(count, "block int, share int, at binary, level binary")

    def signatures(self, levels: DataFrame) -> DataFrame:
        """``doc_id, node, text_key, size, bands``: texts equal word for word have equal keys; no words: a key and no
        bands. ``size`` is the number of shingles."""
        shares, documents = self.shares, self.documents

        def sign(texts: pa.Table, own: pa.Table) -> pa.Table:
            tidy()
            texts = _ordered(texts)
            words = Words(_text_column(texts))
            h, w, first = _weighted(words, own, shares, documents)
            size = np.diff(first)
            some = np.flatnonzero(size)
            bands = np.zeros((len(size), BANDS), np.uint64)
            if len(some):
                samples = icws(h, w, np.append(first[some], len(h))).reshape(len(some), BANDS, R)
                band = np.zeros((len(some), BANDS), np.uint64)
                for j in range(R):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + samples[:, :, j])
                bands[some] = band
            keys = []
            for i in range(len(size)):
                seq = words.hash[words.first[i] : words.first[i + 1]]
                keys.append(_sequence_key(seq))
            lists = [bands[i].view(np.int64).tolist() if size[i] else [] for i in range(len(size))]
            return pa.table({"doc_id": texts.column("doc_id"), "node": pa.array(_nodes(texts)), "text_key": pa.array(keys, pa.string()), "size": pa.array(size), "bands": pa.array(lists, pa.list_(pa.int64()))})

        return self.docs.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(sign, "doc_id long, node long, text_key string, size long, bands array<long>")

    def sets(self, chosen: DataFrame, levels: DataFrame) -> DataFrame:
        """``cluster, k, node, shingles, weights`` of the rows in ``chosen`` (``node, cluster, k``): what is chosen goes
        to the blocks, as the levels do, so that a text travels once."""
        shares, documents = self.shares, self.documents

        def give(texts: pa.Table, own: pa.Table) -> pa.Table:
            tidy()
            kind = own.column("kind").to_numpy()
            rows = own.filter(pa.array(kind == 1))
            if not rows.num_rows:
                return pa.table({"cluster": pa.array([], pa.int64()), "k": pa.array([], pa.int32()), "node": pa.array([], pa.int64()), "shingles": _binary([]), "weights": _binary([])})
            texts = _ordered(texts)
            mine = rows.column("node").to_numpy() & ((1 << 32) - 1)
            h, w, first = _weighted(Words(_text_column(texts)), own.filter(pa.array(kind == 0)), shares, documents)
            return pa.table({"cluster": rows.column("cluster"), "k": rows.column("k").cast(pa.int32()), "node": rows.column("node"), "shingles": _binary([h[first[i] : first[i + 1]] for i in mine]), "weights": _binary([w[first[i] : first[i + 1]] for i in mine])})

        none = lambda kind: F.lit(None).cast(kind)
        block = F.shiftright("node", 32).cast("int")
        both = levels.select("block", F.lit(0).alias("kind"), "share", "at", "level", none("long").alias("node"), none("long").alias("cluster"), none("int").alias("k")).unionByName(
            chosen.select(block.alias("block"), F.lit(1).alias("kind"), none("int").alias("share"), none("binary").alias("at"), none("binary").alias("level"), "node", "cluster", "k")
        )
        return self.docs.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(give, "cluster long, k int, node long, shingles binary, weights binary")

    def classes(self) -> DataFrame:
        """``doc_id, class_id, n_links, kept, node``: see ``near_dedup``; ``node`` tells the rows apart."""
        levels = written(self.frequencies(), "near-levels")
        release(self.spark)
        signed = written(self.signatures(levels), "near-signatures")
        release(self.spark)
        # of equal texts the row with the least id (nulls last) stands for all
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
        keys = signed.groupBy("text_key").agg(F.min("node").alias("rep"), first, F.first("size").alias("size"), F.first("bands").alias("bands"))
        keys = written(keys, "near-texts")
        bands = keys.select("rep", F.posexplode("bands").alias("band", "h"))
        shared = bands.groupBy("band", "h").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        edges = bands.join(shared, ["band", "h"]).filter("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
        clusters = components(written(edges, "near-candidates")).join(keys.select(F.col("rep").alias("node"), "size"), "node")
        found = written(self.links(clusters, levels), "near-links")
        release(self.spark)
        merged = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        ends = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
        # classes of several texts: the first row of all
        several = merged.withColumnsRenamed({"node": "rep"}).join(keys.select("rep", "first"), "rep")
        best = several.groupBy("root").agg(F.min("first").alias("best"))
        several = several.select("rep", "root").join(best, "root").select("rep", "best")
        table = keys.select("text_key", "rep", "first").join(several, "rep", "left").join(ends, "rep", "left")
        table = table.select("text_key", F.coalesce("best", "first").alias("best"), F.coalesce("links", F.lit(0)).alias("n_links"))
        return signed.select("doc_id", "node", "text_key").join(table, "text_key").select("doc_id", F.col("best.doc_id").alias("class_id"), "n_links", (F.col("node") == F.col("best.node")).alias("kept"), "node")

    def deduplicated(self) -> DataFrame:
        """The rows of the table, all columns, of which one stays of each class."""
        kept = self.classes().filter("kept").select(F.shiftright("node", 32).cast("int").alias(self.key), "node")
        schema = self.whole.drop(self.key).schema
        names, text, doc_id = schema.names, self.text, self.doc_id

        def pick(rows: pa.Table, own: pa.Table) -> pa.Table:
            tidy()
            if not own.num_rows or not rows.num_rows:
                return rows.select(names).slice(0, 0)
            import pyarrow.compute as pc

            keyed = pa.table({"doc_id": pc.cast(rows.column(doc_id), pa.int64()), "text": rows.column(text), "at": pa.array(np.arange(rows.num_rows))})
            order = _ordered(keyed).column("at").to_numpy()
            return rows.select(names).take(pa.array(order[own.column("node").to_numpy() & ((1 << 32) - 1)]))

        return self.whole.groupBy(self.key).cogroup(kept.groupBy(self.key)).applyInArrow(pick, schema)

    def links(self, clusters: DataFrame, levels: DataFrame) -> DataFrame:
        """``node, root, links``: for each row of a candidate component (``node, root, size``), and each pair of blocks
        it is in, the least row it is connected to there and the number of distinct texts it is linked with there."""
        size = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
        blocks = F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("shingles") / MEMBER_SHINGLES)).cast("int")
        chosen = clusters.join(size.select("root", blocks.alias("k")), "root").select("node", F.col("root").alias("cluster"), "k")
        sets = self.sets(chosen, levels)
        own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
        tasks = sets.withColumn("own", own).withColumn("pair", F.explode(pair)).select("cluster", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "own", "node", "shingles", "weights")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = tasks.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        least = self.similarity

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in _groups(batches, 3):
                doc, root, links = _verified(group, least)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(root), pa.array(links)], ["node", "root", "links"])
                tidy()

        return dealt.mapInArrow(verify, "node long, root long, links long")


def _sequence_key(words: np.ndarray) -> str:
    import hashlib

    return hashlib.blake2b(words.tobytes(), digest_size=16).hexdigest()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first ``keys`` columns; equal keys come one after the other."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(at[:-1], at[1:], strict=True):
            if i == j:
                continue
            now = tuple(c[i] for c in cols)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _verified(group: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, least row that it is connected to here, links) of the group: a pair is linked where its weighted
    Jaccard similarity is ``least`` or more, and where two blocks meet, only if it has one of each.

    Every pair is compared, one document against all others at a time; what is given is a row a document, however
    many pairs there are.
    """
    ids, own = group.column("node").to_numpy(), group.column("own").to_numpy()
    two = group.column("i")[0].as_py() != group.column("j")[0].as_py()
    sh = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
    w = [np.frombuffer(x.as_buffer(), np.float32) for x in group.column("weights")]
    links = np.zeros(len(ids), np.int64)
    if len(ids) < 2:
        return ids, ids, links
    # by total weight: a pair reaches the similarity only if the lighter one has that share of the heavier one
    total = np.array([x.sum(dtype=np.float64) for x in w])
    order = np.argsort(total, kind="stable")
    ids, own, total = ids[order], own[order], total[order]
    size = np.array([len(sh[i]) for i in order])
    values, local = np.unique(np.concatenate([sh[i] for i in order]), return_inverse=True)
    weight = np.concatenate([w[i] for i in order]).astype(np.float64)
    end = np.cumsum(size)
    begin = end - size
    root = ids.copy()
    dense = np.zeros(len(values))
    for i in range(len(ids) - 1):
        to = int(np.searchsorted(total, total[i] / least * (1 + 1e-9), "right"))
        if to <= i + 1:
            continue
        mine = slice(begin[i], end[i])
        dense[local[mine]] = weight[mine]
        rest = slice(begin[i + 1], end[to - 1])
        common = np.add.reduceat(np.minimum(dense[local[rest]], weight[rest]), begin[i + 1 : to] - begin[i + 1])
        dense[local[mine]] = 0
        near = common / (total[i] + total[i + 1 : to] - common) >= least - 1e-9
        if two:
            near &= own[i + 1 : to] != own[i]
        near = np.flatnonzero(near) + i + 1
        if not len(near):
            continue
        links[i] += len(near)
        links[near] += 1
        joined = np.unique(np.append(root[near], root[i]))
        if len(joined) > 1:
            root[np.isin(root, joined)] = joined[0]
    return ids, root, links


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of its component, for every node of ``edges`` (``a, b``).

    Large-star and small-star steps by turns, each a map and a grouped minimum; a step's result is written to the
    shared folder, so that a lost executor costs one step. A star's centre is aggregated partly before the shuffle.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, last = written(now, "components"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: each greater neighbour is linked to the least; small star: each lesser one and the node itself
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lesser = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lesser, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lesser.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = written(small, "components")
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == last:
            break
        last = sign
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (the least id of its class), ``n_links`` (distinct other texts that
    its text reaches the similarity with), ``kept`` (true for one row of each class).

    Texts that are equal word for word are in one class; so are all texts without words, nulls among them; a text of
    fewer than five words is one shingle. Rows that repeat an id are rows of their own, whose texts alone decide; a null
    id sorts last, and a class without ids has a null ``class_id``. The row that is kept has the least id, of several
    any one. Other columns are ignored; an empty table gives no rows.
    """
    return NearDedup(docs, text, doc_id, similarity).classes().drop("node")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (all its columns) with one row of each class of ``near_dedup``: the one that it marks as kept."""
    return NearDedup(docs, text, doc_id, similarity).deduplicated()
