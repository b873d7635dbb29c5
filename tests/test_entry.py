import importlib
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CHEAP = ("records", "tokens", "document_frequency", "facet_values", "parsed_dates", "date_range_filter", "source_preview")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
@pytest.mark.parametrize("name", CHEAP)
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "labels", "orders", "part"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, expected = entry.queries()[name](spark, DATA).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    key = lambda df: sorted(map(str, df[columns].astype(str).replace("NaT", "None").values.tolist()))
    assert key(got) == key(expected)


def test_entry_imports_without_the_llm_parts(tmp_path):
    root = os.path.dirname(entry.__file__)
    shutil.copytree(f"{root}/coppice", tmp_path / "coppice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split()[-1:] == ["False"], out.stderr
    importlib.reload(entry)
