"""Upserts of revisions by a stateful operator: what is stored of an identity lies in the state store, and each delivery
gets its status when it comes.

A delivery has a revision (``updated_at, source_version, content_hash``), and may have derived fields and attribution:

* another revision than the stored one: ``updated`` if it is greater (later; of equally late ones the greater version,
  then hash), else ``stale``; the first of all is ``created``. An updated identity forgets what was derived from the
  revision before, and its attribution.
* the stored revision again: ``derived_updated`` if it brings a greater shadow or index state, ``metadata_updated`` if
  it brings a field with a later clock (of equal clocks the greater value), else ``deduped``. A shadow is greater by
  its generation, then by being final (a retryable state never takes a final one's place), then by its text; an index
  state by its generation, then by being terminal, then by its time, then by its name.

Each of these is a maximum, so whatever the order of delivery, the stored state is the same in the end (a revision's
``updated_at`` doesn't change). ``delivered`` gives the statuses of a table in order of arrival, ``stored`` the final
state, and ``upserts`` both for a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: States of a shadow that stay, and of an index entry that stay.
FINAL = ("ok", "skipped_raw_mode", "skipped_non_cjk", "skipped_native_session", "skipped_low_value")
TERMINAL = ("indexed", "held_secret", "held_invalid")
#: The attribution of a document; each field has a clock of its own.
FIELDS = ("project", "repo", "device_id")

REVISION = ("updated_at", "source_version", "content_hash")
DELIVERY = "identity string, arrival long, updated_at string, source_version string, content_hash string, shadow_generation long, shadow_status string, shadow_text string, index_generation long, index_status string, indexed_at string, clock string, " + ", ".join(f"{f} string" for f in FIELDS)

_SHADOW = "struct<generation: long, final: int, status: string, text: string>"
_INDEX = "struct<generation: long, terminal: int, at: string, status: string>"
_CLOCKED = "struct<clock: string, value: string>"
STATE = f"revision struct<updated_at: string, source_version: string, content_hash: string>, shadow {_SHADOW}, indexed {_INDEX}, " + ", ".join(f"{f} {_CLOCKED}" for f in FIELDS)
#: What an upsert gives for each delivery: its status, and what is stored behind it.
RESULT = f"identity string, arrival long, status string, {STATE}"


def _revision() -> Column:
    return F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in REVISION])


def _shadow() -> Column:
    own = F.struct(F.coalesce("shadow_generation", F.lit(0)).cast("long").alias("generation"), F.coalesce(F.col("shadow_status").isin(*FINAL), F.lit(False)).cast("int").alias("final"), F.coalesce("shadow_status", F.lit("")).alias("status"), F.coalesce("shadow_text", F.lit("")).alias("text"))
    return F.when(F.col("shadow_status").isNotNull() | F.col("shadow_text").isNotNull(), own)


def _indexed() -> Column:
    own = F.struct(F.coalesce("index_generation", F.lit(0)).cast("long").alias("generation"), F.coalesce(F.col("index_status").isin(*TERMINAL), F.lit(False)).cast("int").alias("terminal"), F.coalesce("indexed_at", F.lit("")).alias("at"), F.coalesce("index_status", F.lit("")).alias("status"))
    return F.when(F.col("index_status").isNotNull(), own)


def _field(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.struct(F.coalesce("clock", "updated_at", F.lit("")).alias("clock"), F.col(name).alias("value")))


def _keyed(rows: DataFrame, *also: str) -> DataFrame:
    """Deliveries as structs that compare as the rules say."""
    return rows.select("identity", "arrival", *also, _revision().alias("revision"), _shadow().alias("shadow"), _indexed().alias("indexed"), *[_field(f).alias(f) for f in FIELDS])


def _greater(new: Column, old: Column) -> Column:
    return F.coalesce(new > old, new.isNotNull())


def delivered(rows: DataFrame, *also: str) -> DataFrame:
    """``identity, arrival, *also, status`` of a table of deliveries, in the order of ``arrival``, equal ones in the
    order of ``also`` (both together differ between the deliveries of an identity)."""
    before = Window.partitionBy("identity").orderBy("arrival", *also).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("identity", "revision").orderBy("arrival", *also).rowsBetween(Window.unboundedPreceding, -1)
    seen = _keyed(rows, *also).select("*", F.max("revision").over(before).alias("_r"), *[F.max(c).over(same).alias(f"_{c}") for c in ("shadow", "indexed", *FIELDS)])
    derived = _greater(F.col("shadow"), F.col("_shadow")) | _greater(F.col("indexed"), F.col("_indexed"))
    moved = F.lit(False)
    for f in FIELDS:
        moved |= _greater(F.col(f), F.col(f"_{f}"))
    status = F.when(F.col("_r").isNull(), "created").when(F.col("revision") < F.col("_r"), "stale").when(F.col("revision") > F.col("_r"), "updated").when(derived, "derived_updated").when(moved, "metadata_updated").otherwise("deduped")
    return seen.select("identity", "arrival", *also, status.alias("status"))


def stored(rows: DataFrame) -> DataFrame:
    """``identity`` and the state after all deliveries of a table, whatever their order. Maxima are combined before the
    shuffle; the deliveries of one revision meet as one row."""
    each = _keyed(rows).groupBy("identity", "revision").agg(*[F.max(c).alias(c) for c in ("shadow", "indexed", *FIELDS)])
    return each.groupBy("identity").agg(F.max(F.struct("revision", "shadow", "indexed", *FIELDS)).alias("s")).select("identity", "s.*")


def _max(old: Any, new: Any) -> Any:
    return new if old is None or (new is not None and tuple(new) > tuple(old)) else old


def _tuple(value: Any) -> tuple | None:
    """A struct as workers get it: a row out of the store, a dict out of a batch."""
    return None if value is None else tuple(value.values()) if isinstance(value, dict) else tuple(value)


def put(state: dict | None, new: dict) -> tuple[str, dict]:
    """The status of one delivery and the state behind it; both hold tuples under the names of STATE."""
    if state is None:
        return "created", new
    if new["revision"] != state["revision"]:
        return ("updated", new) if new["revision"] > state["revision"] else ("stale", state)
    after = {"revision": state["revision"]} | {k: _max(state[k], new[k]) for k in ("shadow", "indexed", *FIELDS)}
    if any(after[k] != state[k] for k in ("shadow", "indexed")):
        return "derived_updated", after
    return ("metadata_updated", after) if after != state else ("deduped", state)


class Upserts(StatefulProcessor):
    """Keeps one value for each identity; the deliveries of a batch are taken by arrival."""

    def __init__(self, kind: T.StructType):
        self.kind, self.names = kind, kind.names  # workers have no session to parse a schema with

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stored", self.kind)

    def named(self, field: str, value: tuple | None) -> dict | None:
        return None if value is None else dict(zip(self.kind[field].dataType.names, value, strict=True))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803, ARG002
        held = self.state.get() if self.state.exists() else None
        state = dict(zip(self.names, map(_tuple, held), strict=True)) if held is not None else None
        begun = state
        for row in sorted(rows, key=lambda r: r["arrival"]):
            status, state = put(state, {n: _tuple(row[n]) for n in self.names})
            yield Row(identity=key[0], arrival=row["arrival"], status=status, **{n: self.named(n, v) for n, v in state.items()})
        if state is not None and state != begun:
            self.state.update(tuple(state[n] for n in self.names))

    def close(self) -> None:
        pass


#: ``transformWithState`` needs this state store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def upserts(stream: DataFrame) -> DataFrame:
    """The status of each delivery of a stream and what is stored behind it (RESULT). The session that starts it must
    have PROVIDER set. An identity's state is a few hundred bytes, and no delivery is kept; deliveries of one identity
    are one task's work in a batch, so a batch should be small against the number of identities."""
    return _keyed(stream).groupBy("identity").transformWithState(Upserts(T.StructType.fromDDL(STATE)), T.StructType.fromDDL(RESULT), "Append", "None")
