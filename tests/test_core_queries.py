"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import os

import pandas as pd
import pytest

from loomlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def shown(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype") or type(value).__name__ == "Decimal":
        try:
            return f"{float(value):.7g}"
        except (TypeError, ValueError):
            return str(value)
    return str(value).removesuffix(" 00:00:00")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(shown, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names():
    import __spark_entry__ as e

    assert registry.FLAGSHIP in registry.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.queries()) <= set(e.queries())


def test_the_rest_does_not_need_the_llm_folders(tmp_path):
    """Without them the entry imports, and nothing else in the library names them."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "loomlake"), tmp_path / "loomlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    n, m = map(int, out.stdout.split())
    assert n >= m > 90
