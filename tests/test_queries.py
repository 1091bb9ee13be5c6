"""Every registered query runs on the smallest tables; those with SQL give its rows."""

import decimal
import glob
import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from marketloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def near(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(near, a, b))
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    r = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    mine = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=str)
    theirs = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    assert len(mine) == len(theirs) and all(map(near, mine, theirs))


def test_entry(spark):
    assert len(entry.entry(spark).collect()) > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name, sql in entry.oracle_sql().items():
        assert isinstance(sql, str) and sql.strip().lower().startswith(("select", "with")), name


@pytest.mark.parametrize("name", ["adaptive", "bar", "causal", "decision", "expert", "extreme", "file", "forecast", "relational", "research", "score", "sequence", "tail"])
def test_modules_import_on_their_own(name):
    subprocess.run([sys.executable, "-c", f"import marketloom.plans.{name}_queries"], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
