"""Growing line files as a stream: each line once, in pieces as the files grow.

The offset of the stream is a map of each file to its inode and the byte behind its last complete line that was read.
A file that grew is read on from there; a new one, one that another took the place of (another inode) and one that was
cut short are read in full, which a row without a line (offset -1) announces: what the file held before is gone, also
where it holds no whole line yet. A line without its line break waits. Files lie in a folder that driver and executors
mount.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.ingest import TURN, valid_turn

NAME = "line_tail"
#: Bytes read at once.
BLOCK = 1 << 20

LINES = T.StructType([T.StructField("source", T.StringType()), T.StructField("inode", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("line", T.StringType()), T.StructField("mode", T.StringType())])


@dataclass
class Stretch(InputPartition):
    """Bytes of one file, from the beginning of a line to the end of one."""

    path: str
    source: str
    inode: int
    start: int
    end: int
    mode: str


def complete_until(path: str, start: int, size: int) -> int:
    """The place behind the last line break of ``path[start:size]``; ``start`` if there is none."""
    with open(path, "rb") as f:
        while size > start:
            begin = max(start, size - BLOCK)
            f.seek(begin)
            at = f.read(size - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.suffixes = tuple(options.get("suffixes", ".jsonl,.ndjson").split(","))
        self.seen: dict[str, list[int]] = {}  # saves looking for the last line break of files that did not change

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def _files(self) -> Iterator[tuple[str, str]]:
        for folder, _, names in os.walk(self.root):
            for name in sorted(names):
                if name.endswith(self.suffixes):
                    path = os.path.join(folder, name)
                    yield path, os.path.relpath(path, self.root)

    def latestOffset(self) -> dict:  # noqa: N802
        now: dict[str, list[int]] = {}
        for path, source in self._files():
            try:
                st = os.stat(path)
                inode, until, size = self.seen.get(source, (0, 0, 0))
                if (inode, size) != (st.st_ino, st.st_size):
                    until = complete_until(path, until if inode == st.st_ino and until <= st.st_size else 0, st.st_size)
            except OSError:
                continue  # gone meanwhile
            now[source] = [st.st_ino, until, st.st_size]
        self.seen = now
        return {"files": json.dumps({s: x[:2] for s, x in sorted(now.items())})}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for source, (inode, until) in after.items():
            old = before.get(source)
            tail = old is not None and old[0] == inode and old[1] <= until
            first = old[1] if tail else 0
            if until > first or not tail:
                out.append(Stretch(os.path.join(self.root, source), source, inode, first, until, "tail" if tail else "full"))
        return out

    def read(self, part: Stretch) -> Iterator[tuple]:
        try:
            f = open(part.path, "rb")
        except FileNotFoundError:
            return  # it went; what takes its place is read in full by a later batch
        with f:
            if os.fstat(f.fileno()).st_ino != part.inode:
                return
            f.seek(part.start)
            at = part.start
            if part.mode == "full":
                yield part.source, part.inode, -1, None, part.mode
            while at < part.end and (line := f.readline()):
                if body := line.rstrip(b"\r\n"):
                    yield part.source, part.inode, at, body.decode("utf-8", "replace"), part.mode
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class LineTail(DataSource):
    """``spark.readStream.format("line_tail").load(folder)``: ``source, inode, offset, line, mode``; option
    ``suffixes``: comma-joined endings of the files to read."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return LINES

    def streamReader(self, schema: T.StructType) -> TailReader:  # noqa: N802, ARG002
        return TailReader(dict(self.options))


def tail(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".jsonl", ".ndjson")) -> DataFrame:
    """The lines of all files under ``folder`` as a stream."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format(NAME).option("suffixes", ",".join(suffixes)).load(folder)


def turns(lines: DataFrame) -> DataFrame:
    """Turns out of lines (``source, offset, mode`` go along); a line that breaks the contract has a null ``turn``
    struct and ``valid`` false, so that the caller can refuse its file."""
    read = lines.filter("offset >= 0").select("source", "inode", "offset", "mode", F.from_json("line", TURN).alias("turn"))
    fields = read.select("*", "turn.*")
    ok = F.coalesce(F.col("turn").isNotNull() & valid_turn(), F.lit(False))
    return fields.select("source", "inode", "offset", "mode", ok.alias("valid"), *[F.when(ok, F.col(n)).alias(n) for n in TURN.names])


def current(lines: DataFrame) -> DataFrame:
    """Of all lines that a tail has given (a table of them, with ``batch``), those that its files hold now: of each file
    what came since it was last read in full, and of lines given twice one."""
    last = lines.groupBy("source").agg(F.max(F.when(F.col("mode") == "full", F.struct("batch", "inode"))).alias("_f"))
    own = lines.join(last, "source").filter((F.col("batch") >= F.col("_f.batch")) & (F.col("inode") == F.col("_f.inode")))
    return own.filter("offset >= 0").groupBy("source", "offset").agg(F.max_by("line", F.struct("batch", "line")).alias("line"))


def keep_lines(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Writes a tail's lines to ``path``, one folder for each micro-batch, so that one that runs again replaces only
    itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number:09d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
