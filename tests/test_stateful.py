"""Upserts over a stream: every status, any order of delivery, a restart from the checkpoint."""

import os
import random

import pytest
from pyspark.sql import types as T

from loomlake.streaming import stateful as S


def deliveries(r, n, identities=6):
    out = []
    for i in range(n):
        revision = r.randrange(3)
        shadow = r.random() < 0.5
        index = r.random() < 0.4
        out.append((
            f"d{r.randrange(identities)}", i, f"2026-01-0{1 + revision}", f"v{revision}", f"h{revision}",
            r.randrange(3) if shadow else None, r.choice(["ok", "pending_provider", "fallback_provider_error"]) if shadow else None, r.choice("xyz") if shadow else None,
            r.randrange(2) if index else None, r.choice(["indexed", "pending", "held_invalid"]) if index else None, r.choice(["1", "2", None]) if index else None,
            r.choice([None, "2026-01-05", "2026-01-06"]), r.choice([None, "p1", "p2"]), r.choice([None, "r1"]), None,
        ))
    return out


def plain(rows):
    """Statuses and final states, one delivery after the other, as the rules say them."""
    state, out = {}, {}
    for d in sorted(rows, key=lambda x: x[1]):
        ident, arrival, revision = d[0], d[1], tuple(d[2:5])
        shadow = (d[5] or 0, int(d[6] in S.FINAL), d[6] or "", d[7] or "") if d[6] is not None or d[7] is not None else None
        index = (d[8] or 0, int(d[9] in S.TERMINAL), d[10] or "", d[9]) if d[9] is not None else None
        fields = [(d[11] or d[2], v) if v is not None else None for v in d[12:15]]
        own = state.get(ident)
        if own is None or revision > own[0]:
            out[ident, arrival] = "created" if own is None else "updated"
            state[ident] = [revision, shadow, index, *fields]
        elif revision < own[0]:
            out[ident, arrival] = "stale"
        else:
            up = [new is not None and (old is None or new > old) for old, new in zip(own[1:], [shadow, index, *fields], strict=True)]
            out[ident, arrival] = "derived_updated" if any(up[:2]) else "metadata_updated" if any(up[2:]) else "deduped"
            for k, new in enumerate([shadow, index, *fields], 1):
                if up[k - 1]:
                    own[k] = new
    return out, {k: tuple(v) for k, v in state.items()}


def states(rows):
    return {r["identity"]: tuple(None if r[c] is None else tuple(r[c]) for c in ("revision", "shadow", "indexed", *S.FIELDS)) for r in rows}


def test_table_forms_match_the_rules(spark):
    rows = deliveries(random.Random(1), 600)
    df = spark.createDataFrame(rows, S.DELIVERY).repartition(5)
    want, final = plain(rows)
    assert {(r["identity"], r["arrival"]): r["status"] for r in S.delivered(df).collect()} == want
    assert set(want.values()) == {"created", "updated", "stale", "deduped", "derived_updated", "metadata_updated"}
    assert states(S.stored(df).collect()) == final
    # whatever the order of delivery, the same is stored
    r = random.Random(2)
    for _ in range(3):
        mixed = [(d[0], k, *d[2:]) for k, d in enumerate(r.sample(rows, len(rows)))]
        assert plain(mixed)[1] == final and states(S.stored(spark.createDataFrame(mixed, S.DELIVERY)).collect()) == final
    assert S.delivered(df.limit(0)).collect() == [] == S.stored(df.limit(0)).collect()


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(S.PROVIDER[0])
    spark.conf.set(*S.PROVIDER)
    yield spark
    spark.conf.set(S.PROVIDER[0], before)


def run(spark, folder, out, check):
    schema = T.StructType.fromDDL(S.DELIVERY)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    q = S.upserts(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None


def test_a_stream_with_a_restart(rocks, tmp_path):
    spark = rocks
    rows = deliveries(random.Random(3), 240)
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    os.makedirs(folder)
    put = lambda part, n: spark.createDataFrame(part, S.DELIVERY).coalesce(1).write.mode("append").parquet(folder)
    put(rows[:80], 1)
    run(spark, folder, out, check)
    put(rows[80:160], 2)
    run(spark, folder, out, check)  # a new query from the same checkpoint
    put(rows[160:], 3)
    run(spark, folder, out, check)
    got = spark.read.parquet(out).collect()
    want, final = plain(rows)
    assert len(got) == len(rows) and {(r["identity"], r["arrival"]): r["status"] for r in got} == want
    last = {}
    for r in got:
        if r["arrival"] >= last.get(r["identity"], r)["arrival"]:
            last[r["identity"]] = r
    assert states(last.values()) == final


def test_events_that_arrive_at_once_get_one_status_each(spark, tmp_path):
    """Events 1000003 apart have one arrival: each has its own row, and the lesser one comes first."""
    from pyspark.sql import functions as F

    from loomlake.plans import registry

    for n, ids in enumerate(([4, 1000007, 7], [7, 1000007, 4])):
        e = spark.createDataFrame([(i,) for i in ids], "event_id long").select("*", F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"))
        e.coalesce(1).write.parquet(f"{tmp_path}/{n}/events.parquet")
        got = {(r["event_id"], r["status"]) for r in registry.queries()["st_upsert_statuses"](spark, f"{tmp_path}/{n}").collect()}
        rows = registry.queries()["st_upsert_statuses"](spark, f"{tmp_path}/{n}").count()
        assert rows == 3 and got == {(4, "created"), (1000007, "updated"), (7, "stale")}
