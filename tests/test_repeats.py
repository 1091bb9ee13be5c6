"""Results that depend on the last bits of a double, or on its sign."""

import datetime as dt
import math
import os

from pyspark.sql import functions as F

from marketloom.operators import scoring
from marketloom.plans import catalog

catalog.load()


def test_p_values_that_differ_when_computed_again(spark):
    fresh = F.udf(lambda: int.from_bytes(os.urandom(6)) / 2**48, "double").asNondeterministic()
    rows = scoring.fdr(spark.range(300).select("id", fresh().alias("p")), "p").collect()
    p = sorted(r.p for r in rows)
    least, want = 1.0, {}
    for i in range(300, 0, -1):
        least = min(least, p[i - 1] * 300 / i)
        want[p[i - 1]] = least
    assert len(rows) == 300 and all(r.q is not None and abs(r.q - want[r.p]) < 1e-12 for r in rows)


def test_normalised_values_below_zero_and_without_spread(spark, tmp_path):
    query = catalog.QUERIES["win15_normalised_subsequence"]
    row = query(spark, "/root/testdata/sf0.1").where("symbol = 'R' and day = date'2001-09-30'").first()
    assert [repr(v) for v in row.z] == ["-0.4867", "-0.512", "-0.1147", "2.5958", "-0.4039", "-0.4882", "-0.0", "-0.5903"]
    lines = [("A", dt.datetime(2000, 1, d), 10.0, 2.0, d, 1, 1) for d in range(1, 9)]
    schema = "l_returnflag string, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_orderkey long, l_linenumber int, l_partkey long"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    (flat,) = query(spark, str(tmp_path)).collect()
    assert len(flat.z) == 8 and all(math.isnan(v) for v in flat.z)
