"""Every registered query with SQL gives the rows of its SQL; the rest of the library stands without the subpackage llm."""

import datetime
import decimal
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    return str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    q = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["fuzzy_sku_match"](spark, SF).where("rank = 1 AND status = 'confirmed'").count() > 0
    assert entry.queries()["greedy_match"](spark, SF).count() > 0


def test_library_stands_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'inventory_summary' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
