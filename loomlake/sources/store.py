"""A versioned table of Parquet snapshots: create, append, overwrite, compaction, replay; files found and opened.

A version is one small record under ``log``, written with ``errorifexists``: of two writers of the same version one
fails and may try again on what the other left. A version names the data folders that make it up, so an append adds
one folder, and an overwrite is one record that names only the new one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "version long, operation string, folders array<string>"
#: Operations after which a compaction that was planned before them may still land (fixed values).
REPLAYABLE = ("append", "config", "reserve")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; only where none is named, as in tests, a temporary
    one of this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="loomlake-")
    return f"{base.rstrip('/')}/loomlake/{name}-{uuid.uuid4().hex}"


class Conflict(RuntimeError):
    """Another writer was first."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).option("recursiveFileLookup", True).json(f"{self.path}/log")

    def head(self) -> tuple[int, list[str]]:
        """The last version and its folders; (-1, []) of a store that isn't there."""
        try:
            last = self.log().orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException:
            return -1, []
        return (last[0]["version"], last[0]["folders"]) if last else (-1, [])

    def _commit(self, read: int, operation: str, folders: list[str]) -> int:
        row = self.spark.createDataFrame([(read + 1, operation, folders)], _LOG).coalesce(1)
        try:
            row.write.mode("errorifexists").json(f"{self.path}/log/{read + 1:020d}")
        except AnalysisException as e:
            raise Conflict(f"version {read + 1} was written by another") from e
        return read + 1

    def _write(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def create(self, rows: DataFrame) -> int:
        """The first version; a store that has one already raises ``Conflict``."""
        if self.head()[0] >= 0:
            raise Conflict(f"{self.path} is there already")
        return self._commit(-1, "create", [self._write(rows)])

    def append(self, rows: DataFrame) -> int:
        folder = self._write(rows)
        while True:  # an append lands on whatever the others left
            version, folders = self.head()
            try:
                return self._commit(version, "append", [*folders, folder])
            except Conflict:
                continue

    def overwrite(self, rows: DataFrame) -> int:
        """All rows at once: readers see the old version or the new one."""
        version, _ = self.head()
        return self._commit(version, "overwrite", [self._write(rows)])

    def read(self) -> DataFrame:
        _, folders = self.head()
        if not folders:
            raise FileNotFoundError(self.path)
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{f}" for f in folders])

    def compact(self, partitions: int, read: int | None = None) -> int | None:
        """All folders merged into one of ``partitions`` files. ``read``: the version that was planned on; what was
        appended since stays beside. ``None`` where another operation landed, so that the plan no longer holds."""
        version, folders = self.head()
        planned = version if read is None else read
        by_version = {r["version"]: (r["operation"], r["folders"]) for r in self.log().filter(F.col("version") >= planned).collect()}
        if not all(by_version[v][0] in REPLAYABLE for v in range(planned + 1, version + 1)):
            return None
        old = by_version[planned][1]
        merged = self._write(self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{f}" for f in old]).repartition(partitions))
        return self._commit(version, "compaction", [merged, *(f for f in folders if f not in old)])


def rows_with_ids(rows: DataFrame, key: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """The asked columns of the rows that pass, each with ``row_id``, the key that later reads and deletes go by."""
    found = rows if where is None else rows.filter(where)
    return found.select(F.col(key).alias("row_id"), *columns)


def compaction_plan(fragments: DataFrame, most_small: int = 256, small_rows: int = 4096) -> DataFrame:
    """``fragments`` (``fragment, n_rows, indexed``) with ``merge``: those under ``small_rows`` rows that aren't
    indexed; where more than ``most_small`` small ones are indexed, these too."""
    small = F.col("n_rows") < small_rows
    all_ = fragments.agg((F.count_if(small & F.col("indexed")) > most_small).alias("_all"))  # one row
    return fragments.crossJoin(F.broadcast(all_)).select("fragment", (small & (~F.col("indexed") | F.col("_all"))).alias("merge"))


def replayable(log: DataFrame, plans: DataFrame) -> DataFrame:
    """``plan, lands``: whether only operations that a compaction may follow landed after the version it read.
    ``log``: ``branch, version, operation``; ``plans``: ``plan, branch, read``."""
    own = plans.join(log, "branch", "left")
    bad = (F.col("version") > F.col("read")) & ~F.col("operation").isin(*REPLAYABLE)
    return own.groupBy("plan").agg((~F.coalesce(F.bool_or(bad), F.lit(False))).alias("lands"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, size, mtime`` of the files below ``path``; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def discover(spark: SparkSession, paths: list[str], pattern: str = "*.jsonl", denied: list[str] | None = None) -> DataFrame:
    """Files below several roots, each once, without those whose path holds a denied part."""
    found = files(spark, paths[0], pattern)
    for p in paths[1:]:
        found = found.unionByName(files(spark, p, pattern))
    for part in denied or []:
        found = found.filter(~F.col("path").contains(part))
    return found.groupBy("path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))


def most_recent(found: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` files changed last; of those changed at once, the first by path."""
    return found.orderBy(F.desc("mtime"), "path").limit(limit)


def signature(found: DataFrame) -> DataFrame:
    """``path, signature``: a stamp that changes with a file's size or time."""
    return found.select("path", F.concat_ws(":", F.col("size").cast("string"), F.unix_micros("mtime").cast("string")).alias("signature"))


def open_turns(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Turns of one file or folder, of its ``limit`` files changed last if asked; an empty or absent folder has none. A
    folder with JSON lines that are no turns is refused whole."""
    from .turns import TURN, read_raw, read_turns, refused

    try:
        found = files(spark, path, "*.jsonl")
        names = [r["path"] for r in (most_recent(found, limit) if limit else found).select("path").collect()]
    except AnalysisException:
        names = []
    if not names:
        return spark.createDataFrame([], TURN)
    if bad := refused(read_raw(spark, names)).orderBy("source_path").limit(3).collect():
        raise ValueError("no turn logs: " + ", ".join(r["source_path"] for r in bad))
    return read_turns(spark, names)


def turn_lines(turns: DataFrame, version: Column) -> DataFrame:
    """``value``: one JSON line a turn, with ``version`` in its turn id, for a log of the open format."""
    return turns.select(F.to_json(F.struct(*[F.concat_ws("@", "turn_uuid", version).alias("turn_uuid") if c == "turn_uuid" else F.col(c) for c in turns.columns])).alias("value"))
