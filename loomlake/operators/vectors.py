"""Embedding with pluggable models, reuse of stored vectors, cells for approximate search, block vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V

DIM = 64
_VECTOR = T.ArrayType(T.FloatType())


def hash_embedder(texts: list[str]) -> np.ndarray:
    """A deterministic stand-in for a model: signed counts of hashed words, of length 1."""
    out = np.zeros((len(texts), DIM))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % DIM] += 1 if h >> 32 & 1 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(body: Column, model: Callable[[list[str]], np.ndarray] = hash_embedder) -> Column:
    """Vectors of a text column; the model is made once for each task and sees Arrow batches."""

    @F.pandas_udf(_VECTOR)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(model(b.fillna("").tolist()).astype(np.float32)))

    return run(body)


def with_reuse(rows: DataFrame, stored: DataFrame, key: str, body: str, model: Callable = hash_embedder) -> DataFrame:
    """``vector`` from ``stored`` (``key, body, vector``) where key and text are the same, else from the model."""
    s = stored.select(F.col(key), F.md5(F.col(body).cast("binary")).alias("_m"), F.col("vector").alias("_v"))
    joined = rows.withColumn("_m", F.md5(F.col(body).cast("binary"))).join(s, [key, "_m"], "left")
    have = joined.filter("_v is not null").withColumn("vector", F.col("_v"))
    new = joined.filter("_v is null").withColumn("vector", embed(F.col(body), model))
    return have.unionByName(new).drop("_m", "_v")


def cells(rows: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """Rows with the number of their nearest centre (``cell``): write them partitioned by it, and a search reads the
    cells near its query."""

    @F.pandas_udf(T.IntegerType())
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(_squares(np.array(v.tolist(), np.float64), centres).argmin(1).astype(np.int32))

    return rows.filter(F.col(vector).isNotNull()).withColumn("cell", nearest(F.col(vector)))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``y``."""
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None]


def _sample(rows: DataFrame, vector: str, most: int) -> np.ndarray:
    """At most ``most`` vectors, a row each."""
    part = rows.select(vector).filter(F.col(vector).isNotNull())
    n = part.count()
    found = [r[0] for r in (part.sample(min(1.0, 1.1 * most / n), 7) if n > most else part).limit(most).collect()]
    return np.array(found, np.float64).reshape(len(found), -1 if found else 0)


def _means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)] if len(x) else x
    for _ in range(rounds if len(x) else 0):
        own = _squares(x, centres).argmin(1)
        centres = np.stack([x[own == i].mean(0) if (own == i).any() else centres[i] for i in range(len(centres))])
    return centres


def centres_of(rows: DataFrame, vector: str, k: int, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """k-means centres of a bounded sample."""
    return _means(_sample(rows, vector, sample), k, rounds)


@dataclass(frozen=True)
class ProductIndex:
    """Centres of the cells, and for each run of ``width`` numbers of what is left of a vector in its cell at most 256
    code words, so that a run is one byte."""

    centres: np.ndarray
    books: tuple[np.ndarray, ...]
    width: int

    @staticmethod
    def fit(rows: DataFrame, vector: str, k: int = 16, width: int = 4, sample: int = 20_000, rounds: int = 10) -> ProductIndex:
        """Learned from at most ``sample`` vectors; all must have the same length. No vectors: an index of no cells."""
        x = _sample(rows, vector, sample)
        centres = _means(x, k, rounds)
        rest = x - centres[_squares(x, centres).argmin(1)] if len(x) else x
        return ProductIndex(centres, tuple(_means(rest[:, i : i + width], 256, rounds) for i in range(0, x.shape[1], width)), width)

    def _runs(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, i : i + self.width] for i in range(0, x.shape[1], self.width)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of each vector."""
        cell = _squares(x, self.centres).argmin(1)
        runs = self._runs(x - self.centres[cell])
        return cell, np.stack([_squares(r, b).argmin(1) for r, b in zip(runs, self.books, strict=True)], 1).astype(np.uint8)

    def table(self, query: np.ndarray, cell: int) -> list[np.ndarray]:
        """Squared distances of each run of the query to each code word of a cell."""
        return [_squares(r, b)[0] for r, b in zip(self._runs((query - self.centres[cell])[None]), self.books, strict=True)]


def coded(rows: DataFrame, key: str, vector: str, index: ProductIndex) -> DataFrame:
    """``key, vector, cell, codes`` of every row with a key and a vector."""

    @F.pandas_udf("cell int, codes binary")
    def encode(v: pd.Series) -> pd.DataFrame:
        cell, codes = index.encode(np.array(v.tolist(), np.float64))
        return pd.DataFrame({"cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes]})

    there = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    return there.withColumn("_c", encode(F.col(vector))).select(key, vector, "_c.cell", "_c.codes")


def index_search(stored: DataFrame, key: str, vector: str, queries: DataFrame, index: ProductIndex, limit: int = 10, probes: int = 12, refine: int = 20, part_rows: int = 65_536, part_queries: int = 16_384) -> DataFrame:
    """``query, key, distance``: about the ``limit`` rows of ``stored`` (see ``coded``) nearest to each of ``queries``
    (``key, vector``), by squared distance, then key.

    A query looks through the ``probes`` nearest cells by its tables of code words, and the ``refine * limit`` best are
    compared in full. Cells and queries are dealt in parts of bounded size, so that a cell with most of the rows is the
    work of many tasks; codes are dealt, vectors only of what is compared in full. Keys must be distinct; queries
    without a key or vector find nothing, nor does any query in an empty index.
    """
    kind = stored.schema[key].dataType.simpleString()
    q = queries.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("_q"))
    if not len(index.centres):
        return q.crossJoin(stored.select(F.col(key)).limit(0)).select("query", key, F.lit(0.0).alias("distance"))
    most = refine * limit
    centres = index.centres

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.argsort(_squares(np.array(v.tolist(), np.float64), centres), axis=1, kind="stable")[:, :probes].astype(np.int32)))

    blocks = max(1, -(-q.count() // part_queries))
    parts = stored.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))  # a row a cell
    left = stored.select(F.col(key).alias("k"), "cell", "codes").join(F.broadcast(parts), "cell")
    left = left.select("k", "codes", "cell", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = q.withColumn("cell", F.explode(near("_q"))).join(F.broadcast(parts), "cell")
    right = right.select("query", "_q", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))

    def look(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query": asked["query"][:0], "k": rows["k"][:0], "about": pd.Series(dtype=float)})
        rows = rows.sort_values("k", kind="stable")
        codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        keys, cell, out = rows["k"].to_numpy(), int(rows["cell"].iloc[0]), []
        for name, v in zip(asked["query"], asked["_q"], strict=True):
            about = np.zeros(len(keys))
            for j, t in enumerate(index.table(np.asarray(v, np.float64), cell)):
                about += t[codes[:, j]]
            at = np.flatnonzero(about <= np.partition(about, most - 1)[most - 1]) if len(keys) > most else np.arange(len(keys))
            at = at[np.argsort(about[at], kind="stable")][:most]
            out.append(pd.DataFrame({"query": name, "k": keys[at], "about": about[at]}))
        return pd.concat(out)

    dealt = ("cell", "part", "block")
    found = left.groupBy(*dealt).cogroup(right.groupBy(*dealt)).applyInPandas(look, f"query {kind}, k {kind}, about double")
    place = lambda *order: F.row_number().over(Window.partitionBy("query").orderBy(*order))
    best = found.withColumn("_n", place("about", "k")).filter(F.col("_n") <= most).select("query", F.col("k").alias(key))
    whole = best.join(stored.select(key, vector), key).join(q, "query").select("query", key, V.l2_squared(F.col(vector), F.col("_q")).alias("distance"))
    return whole.withColumn("_n", place("distance", key)).filter(F.col("_n") <= limit).drop("_n")


def block_vectors(rows: DataFrame, keys: list[str], vector: str, weight: Column) -> DataFrame:
    """A block's vector: the mean of its pieces' by weight, of length 1."""
    e = rows.select(*keys, weight.cast("double").alias("_w"), F.posexplode(vector).alias("_d", "_x"))
    mean = e.groupBy(*keys, "_d").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    both = mean.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("_v"))
    n = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    return both.select(*keys, F.transform("_v", lambda x: F.when(n > 0, x / n).otherwise(x)).alias("vector"))
