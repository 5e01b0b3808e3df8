"""Every registered query of the graph engine against its SQL, and the entry module with and without the text subpackage."""

import glob
import os
import subprocess
import sys
import textwrap

import duckdb
import pytest

from graphlake.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(table, columns):
    return sorted(str([float(x) if isinstance(x, float) else x for x in r]) for r in zip(*(table.column(c).to_pylist() for c in columns), strict=True))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, db, name):
    got = catalog.QUERIES[name](spark, sf).toArrow()
    if name not in catalog.SQL:
        assert got.num_rows
        return
    want = db.execute(catalog.SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_text_subpackage(tmp_path):
    code = """
        import shutil, sys
        sys.path.insert(0, ".")
        import __spark_entry__ as e
        assert "degree_topk" in e.queries() and "degree_topk" in e.oracle_sql()
        assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
    """
    keep = lambda _, names: [n for n in names if n in ("llm", "corpus_pipeline.py", ".git", "tests", "__pycache__")]
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=keep)
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path / "r", check=True)
