import math
import os
import random

import duckdb

from marketloom.operators import tfidf
from marketloom.plans import series_sql
from marketloom.plans.catalog import QUERIES

import marketloom.plans.research_queries  # noqa: F401, I001  registers the query


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return QUERIES["txt01_tfidf_change"](spark, str(tmp_path))


def with_sql(tmp_path):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    return con.sql(series_sql.TFIDF).fetchall()


def same(got, want):
    got, want = (sorted(((r[0] is None, r[0] or 0, -9 if r[1] is None else r[1]) for r in rows)) for rows in (got, want))
    assert len(got) == len(want)
    assert all(x[:2] == y[:2] and math.isclose(x[2], y[2], abs_tol=2e-6) for x, y in zip(got, want, strict=True))


def test_blocks_against_sql(spark, tmp_path, monkeypatch):
    """Nulls, repeated ids, gaps, one-word and very long texts, many blocks and one."""
    rng = random.Random(3)
    text = lambda n: rng.choice([" ", "\n", "\t "]).join(rng.choice(["Ka", "lo", "MIR", "ü", "ß", "x1,"]) + rng.choice(["", "n", "É"]) for _ in range(n))
    rows = [(i * 7 - 50, text(rng.choice([1, 1, 2, 5, 30]))) for i in range(80)]
    rows += [(13, text(9)), (13, text(4)), (20, text(3)), (400_000, text(3000)), (900_000, "  only\none  "), (900_001, None), (900_002, " \n"), (900_003, ""), (2**62, text(5))]
    rows += [(None, text(6)), (None, "ka lo")]
    rng.shuffle(rows)
    for size in (12_000_000, 40, 1):
        monkeypatch.setattr(tfidf, "BLOCK_BYTES", size)
        got = table(spark, tmp_path / str(size), rows).collect()
        same(got, with_sql(tmp_path / str(size)))
    assert table(spark, tmp_path / "none", [(1, None)]).collect() == []
    assert [tuple(r) for r in table(spark, tmp_path / "one", [(1, "A b")]).collect()] == [(1, None)]
    assert [tuple(r) for r in table(spark, tmp_path / "null", [(None, "A b")]).collect()] == [(None, None)]


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    paths = [files.apply(i).getPath() for i in range(files.size())]
    return {p: os.path.getsize(p) for p in paths if os.path.basename(p).startswith("shuffle_") and os.path.exists(p)}


def test_terms_are_moved_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(500))) for i in range(400)]
    frame = table(spark, tmp_path, rows)
    before = shuffled(spark)
    got = frame.collect()
    moved = sum(n for p, n in shuffled(spark).items() if p not in before)
    assert 0 < moved < 4 * sum(len(t) for _, t in rows)
    same(got, with_sql(tmp_path))
