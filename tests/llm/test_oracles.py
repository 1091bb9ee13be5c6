"""The queries that SQL can express give its rows, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from marketloom.llm import queries
from tests.test_queries import SF, near, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    r = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    mine = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=str)
    theirs = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    assert len(mine) == len(theirs) and all(map(near, mine, theirs))


def test_oracles_are_sql():
    for name, sql in entry.oracle_sql().items():
        assert isinstance(sql, str) and sql.strip().lower().startswith(("select", "with")), name
