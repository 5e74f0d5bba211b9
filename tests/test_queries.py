"""Every registered query over the smallest tables, against its SQL in DuckDB."""

import glob
import os
import shutil
import subprocess
import sys

import pytest

from ragweave import plans

duckdb = pytest.importorskip("duckdb")
REGISTRY = plans.load()


def plain(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


@pytest.fixture(scope="module")
def views(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, sf, views, name):
    got = REGISTRY.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    if name not in REGISTRY.ORACLES:
        assert rows
        return
    want = views.sql(REGISTRY.ORACLES[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry_point(spark):
    import __spark_entry__

    assert set(REGISTRY.QUERIES) <= set(__spark_entry__.queries()) and set(REGISTRY.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("left", ["nothing", "an empty folder"])
def test_entry_point_without_the_training_data_package(tmp_path, left):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/ragweave", tmp_path / "ragweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if left == "an empty folder":
        (tmp_path / "ragweave/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) < set(e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout
    assert said.split() == sorted(REGISTRY.QUERIES)
