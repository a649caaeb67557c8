"""Every registered query with SQL against DuckDB on the shared tables, and the rest for rows."""

import glob
import os

import pytest

from tidewright.plans import catalogue

DATA = os.environ.get("TIDEWRIGHT_TEST_TABLES", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    a, b = normal(catalogue.QUERIES[name](spark, DATA).toPandas()), normal(duck.sql(catalogue.ORACLE_SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    for c in a:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 120
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_works_when_the_optional_folders_are_gone(tmp_path):
    """A copy of the repository without the training-data operators, their tests and the pipeline imports and answers."""
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(top, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    assert not (copy / "tidewright/llm").exists() and not (copy / "tests/llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'seasonal_naive_24h' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); import tidewright, bench, tidewright.tasks"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy)


def test_imports_without_the_optional_parts():
    import subprocess
    import sys

    code = "import sys; sys.modules['tidewright.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'seasonal_naive_24h' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
