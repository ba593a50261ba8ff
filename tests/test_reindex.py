"""Reindexing in steps: an interrupted and resumed run, a run at once and a plain one give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from loomlake.streaming import reindex as R


def plain(row, generation, scope):
    r = dict(row)
    free = r["index_status"] != R.HELD
    canonical = (r["content_type"] or "").lower() not in R.LOW_VALUE
    sg, ig, eg = (r[k] or 0 for k in ("shadow_generation", "index_generation", "embedding_generation"))
    if generation > sg:
        sg = generation
        if r["provider_eligible"]:
            r["shadow_text"], r["shadow_status"] = r["raw_text"], R.PENDING
            if generation > ig:
                ig = generation
                if free:
                    r["index_status"] = None
    if scope == "all" and generation > ig:
        ig = generation
        if canonical and free:
            r["index_status"] = None
    if scope == "all" and generation > eg:
        eg = generation
        if canonical and free:
            r["index_status"] = None
    return r | {"shadow_generation": sg, "index_generation": ig, "embedding_generation": eg}


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    some = lambda *x: r.choice(x)
    made = [(i * 3, f"raw{i}", some("memory", "Progress", None), some(True, False, None), some("s", None), some("ok", None), some(0, 1, 2, 5, None), some(R.HELD, "indexed", None), some(0, 2, 4, None), some(0, 3, 6, None)) for i in range(137)]
    return spark.createDataFrame(made, R.ROW).repartition(4).cache()


CONTROLS = [(3, "all"), (5, "retrieval")]


def want(rows):
    out = {}
    for row in rows.collect():
        row = row.asDict()
        for generation, scope in sorted(CONTROLS, reverse=True):
            row = plain(row, generation, scope)
        out[row["id"]] = tuple(row[c] for c in R.CHANGED)
    return out


def seen(df):
    return {r["id"]: tuple((r[c] or 0) if c.endswith("generation") else r[c] for c in R.CHANGED) for r in df.collect()}


def test_all_at_once(spark, rows):
    df = rows
    for generation, scope in sorted(CONTROLS, reverse=True):
        df = R.reset(df, F.lit(generation), F.lit(scope))
    assert seen(df) == want(rows)


def test_steps_with_an_interruption(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    job = R.Reindex(spark, path, CONTROLS, step=50)
    assert job.run_step(rows) and job.run_step(rows)
    assert [(p["generation"], p["cursor"], p["applied"]) for p in job.progress()] == [(5, 147, False), (5, 297, False)]  # newest first, 50 ids a step
    # broken off behind its changes: the step hasn't been
    real = spark.createDataFrame
    before = seen(job.current(rows))

    def breaks(data, schema=None, *a, **k):
        if isinstance(schema, str) and schema.startswith("step long, generation") and data:
            raise RuntimeError("lost")
        return real(data, schema, *a, **k)

    monkeypatch.setattr(spark, "createDataFrame", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        job.run_step(rows)
    monkeypatch.setattr(spark, "createDataFrame", real)
    resumed = R.Reindex(spark, path, CONTROLS, step=50)
    assert len(resumed.progress()) == 2 and seen(resumed.current(rows)) == before
    assert seen(resumed.drain(rows)) == want(rows)
    assert [(p["generation"], p["applied"]) for p in resumed.progress()] == [(5, False), (5, False), (5, True), (3, False), (3, False), (3, True)]
    assert not resumed.run_step(rows)
    # a later control goes over the rows again
    later = R.Reindex(spark, path, [*CONTROLS, (9, "all")], step=1000)
    assert seen(later.drain(rows)) == {k: v for k, v in ((r["id"], tuple(plain(r.asDict(), 9, "all")[c] for c in R.CHANGED)) for r in resumed.current(rows).collect())}


def test_nothing_to_do(spark, rows, tmp_path):
    assert seen(R.Reindex(spark, str(tmp_path / "a"), []).drain(rows)).keys() == want(rows).keys()
    assert R.Reindex(spark, str(tmp_path / "b"), CONTROLS).drain(rows.limit(0)).collect() == []
