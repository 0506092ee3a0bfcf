"""Queries against their SQL, on the smallest tables that are there."""

import glob
import os

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
import __spark_entry__ as entry  # noqa: E402

CHECKED = sorted(k for k in entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(names) and got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
