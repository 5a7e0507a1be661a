"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sumloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    found = sorted(tuple(r[c] for c in cols) for r in df.collect())
    rel = duck.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert found == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_entry_imports_without_the_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['sumloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline_small' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; e.oracle_sql()"
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True)
