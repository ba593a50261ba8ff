"""A content-addressed store of token ids.

A rolling hash over the last ids of a document cuts its id stream into chunks, so equal passages give equal chunks
wherever they stand. A chunk's address is the SHA-256 of its bytes; each distinct chunk is stored once. A document's
recipe lists its chunk addresses in order and their Merkle root; the manifest holds a Merkle root per range of
documents and one over all, whose leaves hash everything a recipe says. Reading checks every chunk against its address,
the root against the chunks that were put together, and every recipe against the manifest.

Layout under one folder (Parquet containers, so that any store Spark writes to will do):
  pool/kind=chunk   address binary, row binary, at long, n long, ids binary (little-endian, ``width`` bytes an id, as
                    a zstd frame), shared boolean (whether it has uses besides this one)
  pool/kind=use     address binary, row binary, doc_id long, at long (the chunk's place in its document), n long
  recipes           part int, doc_id long, row binary, copies long, start long (of the first copy), n_tokens long,
                    chunks array<binary>, root binary
A row is the hash of a document's id and ids: documents under one id, or without one, are told apart, and rows that
are equal in both share a recipe that says how many they are.
  manifest          part int, first_start long, n_docs long, n_ids long, width int, root binary (part -1: over all)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, by_slices, new_path, release, remove, shuffle_partitions
from .tok import default_path, encoder

#: Ids that the rolling hash sees; a cut falls where its low bits are 0, on average each MEAN ids, but not before MIN
#: ids and after MAX ids at the latest.
SEEN, MEAN, MIN, MAX = 16, 512, 64, 4096

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hits(ids: np.ndarray) -> np.ndarray:
    """Places before which the ids' rolling hash has its low bits 0."""
    if len(ids) < SEEN:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h, k, power = (ids.astype(np.uint64) + np.uint64(1)) * _ODD, 1, _ODD
        while k < SEEN:  # the hash of 2k ids from those of k: h[i] is of ids[i : i + k]
            h = h[:-k] * power + h[k:]
            power, k = power * power, 2 * k
        h ^= h >> np.uint64(29)
    return np.flatnonzero((h & np.uint64(MEAN - 1)) == 0) + SEEN


def cut_points(ids: np.ndarray, hits: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of one id stream (the last is its length). ``hits``: its places, where they are known."""
    n = len(ids)
    if n <= MIN:
        return [n]
    places = (_hits(ids) if hits is None else hits).tolist()
    ends, last = [], 0
    for at in places:
        while at - last > MAX:
            last += MAX
            ends.append(last)
        if at - last >= MIN and at < n:
            ends.append(at)
            last = at
    while n - last > MAX:
        last += MAX
        ends.append(last)
    return [*ends, n] if not ends or ends[-1] < n else ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """Leaves and inner nodes are hashed with different first bytes; an odd node goes up as it is; none: the hash of
    nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encodes every whole text, appends ``end_id``, and writes the store in ascending order of ``doc_id``.

    Null texts are empty (the end id alone). Documents without an id come last; those that share an id are documents of
    their own, in the order of their hash, and each comes back as often as it was given. Other columns are ignored. An
    empty table gives a store of no documents.
    """
    spark = docs.sparkSession
    file = tokenizer or default_path()
    width = encoder(file).kind.itemsize
    bounded_batches(spark)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        stored: set[bytes] = set()  # addresses this task has sent, to send a copy's bytes once; bounded below
        told: set[bytes] = set()  # those it has sent word of that they come again

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, at = encoder(file).encode(batch.column(1))
            # every document with its end id, one after the other; places that see two documents are left out
            whole, first = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
            hits = _hits(whole)
            lo, hi = np.searchsorted(hits, first[:-1] + SEEN), np.searchsorted(hits, first[1:], "right")
            names, rows, doc, place, count, blob, tell = [], [], [], [], [], [], []
            for k, d in enumerate(batch.column(0).to_pylist()):
                own = whole[first[k] : first[k + 1]]
                row = hashlib.blake2b(own.tobytes(), digest_size=16, key=repr(d).encode()).digest()
                last = 0
                for i, end in enumerate(cut_points(own, hits[lo[k] : hi[k]] - first[k])):
                    raw = own[last:end].tobytes()
                    address = hashlib.sha256(raw).digest()
                    names.append(address)
                    rows.append(row)
                    doc.append(d)
                    place.append(i)
                    count.append(end - last)
                    blob.append(None if address in stored else packer.compress(raw))
                    tell.append(address not in told)
                    if address in stored:
                        told.add(address)
                    stored.add(address)
                    last = end
            if len(stored) > 200_000:
                stored.clear()
                told.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(rows, pa.binary()), pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(count, pa.int64()), pa.array(blob, pa.binary()), pa.array(tell, pa.bool_())], ["address", "row", "doc_id", "at", "n", "ids", "tell"])

        yield from by_slices(one, "text")(batches)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    uses = rows.mapInArrow(chunked, "address binary, row binary, doc_id long, at long, n long, ids binary, tell boolean")
    # each use is a row; of a chunk, a task sends one row with its bytes and at most one more that tells it comes again,
    # and the rows of an address meet in one partition
    tagged = uses.select("*", F.explode(F.when(F.col("tell"), F.array(F.lit("use"), F.lit("chunk"))).otherwise(F.array(F.lit("use")))).alias("kind"))
    n = shuffle_partitions(spark)
    is_use = F.col("kind") == "use"
    dealt = tagged.select("kind", "address", "row", "doc_id", "at", "n", F.when(~is_use, F.col("ids")).alias("ids"), F.when(is_use, F.pmod(F.xxhash64("row", "at"), F.lit(1 << 20))).otherwise(F.lit(-1)).alias("_salt"))
    # of the rows of a chunk the first with its bytes stays, and tells whether there are more
    same = Window.partitionBy("kind", "address", "_salt").orderBy(F.col("ids").isNull(), "row", "at")
    shared = F.when(is_use, F.lit(None).cast("boolean")).otherwise(F.lead("at").over(same).isNotNull())
    pool = dealt.repartition(n, "kind", "address", "_salt").select("*", F.row_number().over(same).alias("_first"), shared.alias("shared")).filter(is_use | (F.col("_first") == 1)).select("kind", "address", "row", "doc_id", "at", "n", "ids", "shared")
    pool.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/pool")
    release(spark)

    used = spark.read.schema(_POOL).parquet(f"{path}/pool").filter("kind = 'use'").select("address", "row", "doc_id", "at", "n")
    # copies of a row are counted before its chunks are collected
    used = used.groupBy("row", "at", "address").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    recipes = used.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("copies").alias("copies"), F.sum("n").alias("n_tokens"), F.transform(F.sort_array(F.collect_list(F.struct("at", "address"))), lambda x: x["address"]).alias("chunks"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    recipes.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "row", "copies", "n_tokens", "chunks").write.parquet(staged := f"{path}/staged")
    kept = spark.read.schema("part int, doc_id long, row binary, copies long, n_tokens long, chunks array<binary>").parquet(staged)
    firsts, total = {}, 0
    for r in kept.groupBy("part").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).orderBy("part").collect():  # one row per range
        firsts[r["part"]], total = total, total + r["n"]
    offsets = spark.createDataFrame([(int(k), int(v)) for k, v in firsts.items()], "part int, first_start long")

    @F.pandas_udf("binary")
    def root(chunks):  # noqa: ANN001, ANN202
        return chunks.map(lambda c: merkle_root(list(c)))

    before = F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept.withColumn("_before", before).join(F.broadcast(offsets), "part").select("part", "doc_id", "row", "copies", (F.col("first_start") + F.col("_before")).alias("start"), "n_tokens", "chunks", root("chunks").alias("root")).write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(spark, path, width).write.parquet(f"{path}/manifest")
    remove(spark, staged)


def _leaf(doc_id: int | None, row: bytes, copies: int, start: int, n_tokens: int, root: bytes) -> bytes:
    return f"{doc_id},{copies},{start},{n_tokens},".encode() + row + root


def _range_roots(recipes: DataFrame) -> DataFrame:
    """part, first_start, n_docs, n_ids, root: over all that a range's recipes say, in the order of their starts."""

    def f(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("start")
        said = [rows.column(c).to_pylist() for c in ("doc_id", "row", "copies", "start", "n_tokens", "root")]
        copies, starts, n = said[2:5]
        return pa.table({"part": rows.column("part")[:1], "first_start": [starts[0]], "n_docs": [sum(copies)], "n_ids": [sum(c * k for c, k in zip(copies, n, strict=True))], "root": [merkle_root([_leaf(*x) for x in zip(*said, strict=True)])]})

    return recipes.select("part", "doc_id", "row", "copies", "start", "n_tokens", "root").groupBy("part").applyInArrow(f, "part int, first_start long, n_docs long, n_ids long, root binary")


_MANIFEST = "part int, first_start long, n_docs long, n_ids long, width int, root binary"


def _manifest(spark: SparkSession, path: str, width: int) -> DataFrame:
    rows = sorted(_range_roots(spark.read.schema(_RECIPES).parquet(f"{path}/recipes")).collect())  # one row per range
    top = (-1, 0, sum(r["n_docs"] for r in rows), sum(r["n_ids"] for r in rows), width, merkle_root([bytes(r["root"]) for r in rows]))
    return spark.createDataFrame([top, *((r["part"], r["first_start"], r["n_docs"], r["n_ids"], width, bytes(r["root"])) for r in rows)], _MANIFEST).coalesce(1)


_POOL = "address binary, row binary, doc_id long, at long, n long, ids binary, shared boolean, kind string"
_RECIPES = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("row", T.BinaryType()), T.StructField("copies", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("chunks", T.ArrayType(T.BinaryType())), T.StructField("root", T.BinaryType())])


class CorruptStore(ValueError):
    """A store whose parts don't match its manifest."""


def verify_manifest(spark: SparkSession, path: str) -> int:
    """Checks what the recipes say against the manifest; returns the width of an id in bytes."""
    said = {r["part"]: r for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()}
    now = _manifest(spark, path, said[-1]["width"]).collect()
    if {r["part"]: bytes(r["root"]) for r in now} != {k: bytes(r["root"]) for k, r in said.items()}:
        raise CorruptStore(f"{path}: recipes don't match the manifest")
    return said[-1]["width"]


def read_store(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of every document, put together from its
    chunks. Missing chunks raise ``CorruptStore``; with ``check``, so do a chunk that differs from its address, chunks
    whose Merkle root isn't the recipe's, and recipes that differ from the manifest.
    """
    width = verify_manifest(spark, path) if check else spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").first()["width"]
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    pool = spark.read.schema(_POOL).parquet(f"{path}/pool")
    chunks = pool.filter("kind = 'chunk'")
    # a chunk with one use goes to its document as it is; of the few with more, every use fetches the bytes
    uses = pool.filter("kind = 'use'").select("address", "row", "at").distinct()  # copies of a row use the same
    pieces = chunks.filter("not shared").select("row", "at", "ids").unionByName(uses.join(chunks.filter("shared").select("address", "ids"), "address").select("row", "at", "ids"))
    got = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("got"))
    found = recipes.select("doc_id", "row", "copies", "start", "n_tokens", "chunks", "root").join(got, "row", "left").select("doc_id", "copies", "start", "n_tokens", "got", "chunks", "root")

    names_out = ["doc_id", "start", "n_tokens", "ids"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdDecompressor()

        def chunk(ids: bytes, address: bytes) -> bytes:
            try:
                raw = packer.decompress(ids)
            except zstandard.ZstdError as e:
                raise CorruptStore("a chunk is no zstd frame") from e
            if check and hashlib.sha256(raw).digest() != address:
                raise CorruptStore("a chunk differs from its address")
            return raw

        for b in batches:
            out, at, start = [], [], []
            for i, (copies, first, n_tokens, got, names, root) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 7)), strict=True)):
                own = {x["at"]: x["ids"] for x in got or ()}
                if check and merkle_root(names) != root:
                    raise CorruptStore("a document's chunks are not those of its root")
                if sorted(own) != list(range(len(names))):
                    raise CorruptStore("chunks of a document are missing")
                raw = b"".join(chunk(own[k], name) for k, name in enumerate(names))
                if len(raw) != n_tokens * width:
                    raise CorruptStore("a document's chunks are of another length")
                raw = raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                for k in range(copies):
                    out.append(raw)
                    at.append(i)
                    start.append(first + k * n_tokens)
                    if len(out) * len(raw) > 8 << 20:  # many copies of one document
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(start), b.column(3).take(pa.array(at)), pa.array(out, pa.binary())], names_out)
                        out, at, start = [], [], []
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(start), b.column(3).take(pa.array(at)), pa.array(out, pa.binary())], names_out)

    return found.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids binary")


def store_and_read(docs: DataFrame, path: str | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Writes the store under ``path`` (a new folder in the shared one) and reads it back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    write_store(docs, path, **options)
    release(spark)
    return read_store(spark, path)
