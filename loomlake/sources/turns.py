"""Turn logs as JSON lines: batch and stream readers; a file with one bad line is refused whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import TURN, valid_turn

_CORRUPT = "_corrupt"


def _schema() -> T.StructType:
    return T.StructType([*TURN.fields, T.StructField(_CORRUPT, T.StringType())])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(_schema()).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("file_mtime"))


def refused(rows: DataFrame) -> DataFrame:
    """``source_path, bad_lines`` of files with a line that breaks the contract."""
    bad = F.col(_CORRUPT).isNotNull() | ~valid_turn()
    return rows.filter(bad).groupBy("source_path").agg(F.count(F.lit(1)).alias("bad_lines"))


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns of the files that keep the contract."""
    rows = read_raw(spark, path)
    return rows.join(refused(rows).select("source_path"), "source_path", "left_anti").drop(_CORRUPT)


def stream_turns(spark: SparkSession, path: str, files_per_batch: int = 32, archive: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(TURN).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(path)


def unique_turns(turns: DataFrame) -> DataFrame:
    """Of turns that repeat an id, the first by seq."""
    rest = [c for c in turns.columns if c not in ("session_id", "turn_uuid")]
    best = turns.groupBy("session_id", "turn_uuid").agg(F.min_by(F.struct(*rest), F.struct("seq", "ts")).alias("_r"))
    return best.select("session_id", "turn_uuid", "_r.*")


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """All tables as typed JSON records, compressed."""
    frames = [df.select(F.to_json(F.struct(F.lit(name).alias("type"), F.struct(*df.columns).alias("row"))).alias("value")) for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    out.write.option("compression", "gzip").text(path)


def read_snapshot(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    kind = T.StructType([T.StructField("type", T.StringType()), T.StructField("row", schema)])
    return spark.read.text(path).select(F.from_json("value", kind).alias("r")).filter(F.col("r.type") == name).select("r.row.*")
