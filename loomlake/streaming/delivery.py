"""A durable queue between a stream and a sink that can fail: every row arrives at least once.

The queue is a table of versioned snapshots under one folder. Each micro-batch puts its rows in, takes what is due, and
hands it to the sink in batches of bounded bytes, in as many lanes as there are partitions. A batch that the sink takes
leaves the queue; the rows of one that it refuses wait longer with each attempt. A micro-batch that is run again after
a failure finds the snapshot before it and sends again what it had sent: at least once, and exactly once where nothing
fails between the sink and the snapshot.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .upserts import backoff_seconds, snapshot

#: ``since``: when a row's revision came; a later one under the same id takes its place and starts anew.
QUEUE = "id string, payload string, since long, attempts int, next_at double, error string"
#: Payload bytes and rows of a batch, and characters of an error that are kept (fixed value).
MOST_BYTES, MOST_ROWS, ERROR = 1 << 20, 1_000, 1_000

Sink = Callable[[list[str]], None]


def framed_bytes(payload: Column) -> Column:
    """A payload and its line break."""
    return F.octet_length(payload) + 1


def batched(rows: DataFrame, lane: str, order: list[str], most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS) -> DataFrame:
    """``rows`` of the first batch of each lane: from its beginning on while the bytes and the rows fit; a payload that
    is too long by itself is a batch of its own."""
    w = Window.partitionBy(lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = rows.withColumn("_bytes", F.sum(framed_bytes(F.col("payload"))).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    return size.filter((F.col("_n") == 1) | ((F.col("_bytes") <= most_bytes) & (F.col("_n") <= most_rows))).drop("_bytes", "_n")


def retried(rows: DataFrame, now: Column) -> DataFrame:
    """Refused rows: one attempt more, and a wait of 30 seconds that doubles with each attempt before, an hour at most."""
    return rows.withColumn("next_at", now + backoff_seconds(F.col("attempts"))).withColumn("attempts", F.col("attempts") + 1)


def latest(rows: DataFrame) -> DataFrame:
    """Of the rows under one id the one that came last; of equally late ones the one that waits since the least
    attempts, then the greater payload."""
    rest = [c for c in rows.columns if c not in ("id", "since")]
    best = F.max_by(F.struct("since", *rest), F.struct("since", (-F.col("attempts")).alias("a"), "payload"))
    return rows.groupBy("id").agg(best.alias("_r")).select("id", F.col("_r.payload").alias("payload"), F.col("_r.since").alias("since"), F.col("_r.attempts").alias("attempts"), F.col("_r.next_at").alias("next_at"), F.col("_r.error").alias("error"))


def sender(sink: Sink, most_bytes: int, most_rows: int):  # noqa: ANN201
    """For ``mapInArrow``: hands the rows it gets to ``sink`` batch by batch, and tells of each what came of it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            error = None
            try:
                sink([p for _, p in held])
            except Exception as e:  # noqa: BLE001 - whatever the sink raises keeps the rows in the queue
                error = f"{type(e).__name__}: {e}"[:ERROR]
            out = pa.RecordBatch.from_arrays([pa.array([i for i, _ in held]), pa.array([error] * len(held), pa.string())], ["id", "error"])
            held.clear()
            return out

        for batch in batches:
            for i, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = len((payload or "").encode()) + 1
                if held and (size + own > most_bytes or len(held) >= most_rows):
                    yield flush()
                    size = 0
                held.append((i, payload or ""))
                size += own
        if held:
            yield flush()

    return send


def cycle(queue: DataFrame, sink: Sink, now: float, lanes: int = 4, most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The queue after one cycle: due rows are sent, in each lane by the time they are due. ``keep`` must store what
    came of it, so that nothing is sent again when the result is read twice."""
    due = queue.filter(F.col("next_at") <= now)
    dealt = due.select("id", "payload", "next_at").repartition(lanes, "id").sortWithinPartitions("next_at", "id")
    outcome = keep(dealt.select("id", "payload").mapInArrow(sender(sink, most_bytes, most_rows), "id string, error string"))
    bad = outcome.filter("error is not null")
    waiting = queue.filter(F.col("next_at") > now)
    failed = due.drop("error").join(bad, "id")
    return waiting.unionByName(retried(failed, F.lit(now)).select(*waiting.columns))


def pending(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """What waits in the queue under ``path``."""
    found = snapshot(spark, path, below)
    return spark.createDataFrame([], QUEUE) if found is None else found


def deliver(stream: DataFrame, sink: Sink, path: str, checkpoint: str, clock: Callable[[], float] = time.time, lanes: int = 4, most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS):  # noqa: ANN201
    """A stream of ``id, payload`` (strings) into ``sink`` through the queue under ``path``; returns a stream writer.

    The sink runs on the executors and gets a list of payloads; it refuses them by raising. A later row under an id
    that still waits takes its place; a row without an id only makes the queue look for what is due.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, clock()

        def kept(df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{path}-sent/batch={number:09d}")
            return spark.read.schema(df.schema).parquet(f"{path}-sent/batch={number:09d}")

        new = batch.filter("id is not null").select(F.col("id").cast("string").alias("id"), "payload", F.lit(number).cast("long").alias("since"), F.lit(0).alias("attempts"), F.lit(0.0).alias("next_at"), F.lit(None).cast("string").alias("error"))
        queue = latest(pending(spark, path, below=number).unionByName(new))
        cycle(queue, sink, now, lanes, most_bytes, most_rows, kept).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def ticks(spark: SparkSession, seconds: int = 30) -> DataFrame:
    """Rows without id that come now and then, to be put together with a quiet stream: waiting rows are sent in its
    micro-batches, and a stream without rows has none."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", 1000 * seconds).load().select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("payload"))
