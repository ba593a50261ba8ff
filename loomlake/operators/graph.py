"""Similar pairs within groups, and connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block, about, and rows of a matrix product.
BLOCK, SLICE = 2048, 512


def _pairs(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` whose dot product, summed in the order of the dimensions as a fold would, is ``least`` or
    more. A matrix product finds them, and only what it puts within its rounding of ``least`` is summed again."""
    sim = x @ y.T
    slack = 1e-13 * x.shape[1] * np.sqrt((x * x).sum(1).max(initial=0.0) * (y * y).sum(1).max(initial=0.0))
    a, b = np.nonzero(sim >= least - slack)
    close = np.flatnonzero(sim[a, b] <= least + slack)
    bad = close[~(_folded(x, y, a[close], b[close]) >= least)]
    return np.delete(a, bad), np.delete(b, bad)


def _folded(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sim = np.zeros(len(a))
    for d in range(x.shape[1] if len(a) else 0):
        sim += x[a, d] * y[b, d]
    return sim


def hanging(x: np.ndarray, least: float, first: int = 0) -> np.ndarray:
    """The least row that each row of ``x`` hangs together with by dot products of ``least`` or more; where ``first`` is
    given, only links between the first so many rows and the others are looked for (any others may count too).

    What is linked to one row is one class already and isn't compared among itself, so that a group of copies costs no
    square."""
    root = np.arange(len(x))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            m, n = root[a], root[b]
            open_ = m != n
            a, b, m, n = a[open_], b[open_], m[open_], n[open_]
            np.minimum.at(root, np.maximum(m, n), np.minimum(m, n))
            while (root[root] != root).any():
                root[:] = root[root]

    few = np.unique(np.linspace(0, max(len(x) - 1, 0), 8).astype(int))[: len(x)]
    own, leader = _pairs(x, x[few], least)
    held = np.zeros(len(x), bool)
    if len(own):
        held[own[leader == np.bincount(leader).argmax()]] = True
        root[held] = np.flatnonzero(held)[0]
        join(own, few[leader])
    some, rest = np.flatnonzero(held), np.flatnonzero(~held)
    if first:
        parts = [(some[some < first], rest[rest >= first]), (rest[rest < first], np.arange(first, len(x)))]
    else:
        parts = [(rest, None)]
    for left, right in parts:
        for i in range(0, len(left), SLICE):
            now = left[i : i + SLICE]
            to = np.concatenate([some, rest[i:]]) if right is None else right
            a, b = _pairs(x[now], x[to], least)
            join(now[a], to[b])
    return root


def _dealt(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """``g, i, j, own, k, v``: each group in blocks of about BLOCK members, each pair of blocks together."""
    there = rows.filter(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull())
    size = there.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k"))
    own = there.select(group, key, vector).join(size, group).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_k")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: F.struct(F.least(j, F.col("_own")).alias("i"), F.greatest(j, F.col("_own")).alias("j")))
    dealt = own.withColumn("_p", F.explode(pair)).select(F.col(group).alias("g"), F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), F.col("_own").alias("own"), F.col(key).alias("k"), F.col(vector).alias("v"))
    # small in bytes but not in work, so no partitions are put together
    return dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "i", "j")


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and vectors of a pair of blocks by block, then key, and the first one's size (0: one block alone)."""
    pdf = pdf.sort_values(["own", "k"], kind="stable")
    return pdf["k"].to_numpy(), np.array(pdf["v"].tolist(), np.float64), int((pdf["own"] == pdf["i"]).sum()) if pdf["i"].iloc[0] != pdf["j"].iloc[0] else 0


def similar_pairs(rows: DataFrame, group: str, key: str, vector: str, least: float) -> DataFrame:
    """``group, a, b, similarity`` (a < b) of all pairs of a group whose vectors' dot product is ``least`` or more.

    A group is dealt into blocks of about BLOCK members and each pair of blocks is compared by matrix products: a hot
    group is many tasks of bounded size. The work is the square of a group's size, as all its pairs are asked for.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        k, x, first = _sides(pdf)
        found = []
        for i in range(0, first or len(x), SLICE):
            to = first or i
            a, b = _pairs(x[i : min(i + SLICE, first or len(x))], x[to:], least)
            a, b = a + i, b + to
            if not first:
                a, b = a[a < b], b[a < b]
            found.append(pd.DataFrame({"g": pdf["g"].iloc[0], "a": np.minimum(k[a], k[b]), "b": np.maximum(k[a], k[b]), "similarity": _folded(x, x, a, b)}))
        return pd.concat(found) if found else pd.DataFrame({"g": pdf["g"][:0], "a": k[:0], "b": k[:0], "similarity": np.zeros(0)})

    kind = dict(rows.dtypes)
    return _dealt(rows, group, key, vector).groupBy("g", "i", "j").applyInPandas(compare, f"g {kind[group]}, a {kind[key]}, b {kind[key]}, similarity double").withColumnRenamed("g", group)


def similar_links(rows: DataFrame, group: str, key: str, vector: str, least: float) -> DataFrame:
    """``a, b``: enough links for the components of ``similar_pairs``, at most one a member and pair of blocks."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        k, x, first = _sides(pdf)
        root = hanging(x, least, first)
        own = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": k[root[own]], "b": k[own]})

    kind = dict(rows.dtypes)
    return _dealt(rows, group, key, vector).groupBy("g", "i", "j").applyInPandas(compare, f"a {kind[key]}, b {kind[key]}")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node that each node of ``edges`` (``a, b``) is linked to, by rounds of large-star and
    small-star steps; each round's result is checkpointed, so that a lost executor costs one round."""
    spark = edges.sparkSession
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        from ..sources.store import shared_folder

        spark.sparkContext.setCheckpointDir(shared_folder(spark, "graph"))
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct().checkpoint()
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lesser = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lesser, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lesser.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = small.checkpoint()
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == last:
            roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        last = sign
