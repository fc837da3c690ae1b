import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def rows(df):
    def text(v):
        if v is None or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert "seqchar" in entry.entry(spark).columns


def test_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'get_dfphrase' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True, timeout=300)


def test_a_broken_operator_is_an_error(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    module = copy / "gramforge" / "llm" / "queries.py"
    if not module.exists():
        pytest.skip("the operators are not there")
    module.write_text("import a_module_that_is_missing\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, timeout=300)
    assert done.returncode and b"a_module_that_is_missing" in done.stderr
