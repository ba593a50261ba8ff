"""What the operators of this subpackage share: the shared folder, tables that cut lineage, batches."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts of one Arrow slice that a Python worker holds at once (a longer text is a slice of its own).
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where it is unset (tests) a
    temporary folder of this machine."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomlake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it survives lost executors and is computed once."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver collects its garbage; between two large phases that is now.
    The second time frees what only the first one's finalizers let go of."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` in which ``column`` has at most ``most`` bytes, or a single row."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


_tidied = [0.0]


def tidy() -> None:
    """Gives memory that Arrow and the C library keep after large arrays back to the system. Workers live on from stage
    to stage, and what one stage's tables needed would otherwise add to the next one's. Once a second at most."""
    if time.monotonic() - _tidied[0] < 1:
        return
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)
    _tidied[0] = time.monotonic()


def by_slices(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str) -> Callable:
    """A function for ``mapInArrow`` that gives ``f`` slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, column):
                if (out := f(part)) is not None and out.num_rows:
                    yield out
                tidy()

    return run


def text_buffer(array: pa.Array):
    """(bytes, offsets) of an Arrow string array as numpy views; nulls are empty."""
    import numpy as np
    import pyarrow.compute as pc

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "").cast(pa.large_string())
    off = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Rows per Arrow batch, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def with_fields(schema, **kinds: str):  # noqa: ANN001, ANN201
    """``schema`` (left as it is) and more fields of the given types."""
    from pyspark.sql import types as T

    out = T.StructType(list(schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the columns that an operator would replace under other names, and a function that gives the
    operator's result the columns of ``df`` again, with their own values."""
    from pyspark.sql import functions as F

    lower, own = {n.lower() for n in names}, {}
    mark = "_own_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark = "_" + mark
    for c in df.columns:
        if c.lower() in lower:
            own[c] = mark + c
    there = df.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in df.columns])
    return there, lambda out: out.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in df.columns])
