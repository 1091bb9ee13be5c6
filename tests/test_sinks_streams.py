import datetime as dt

from pyspark.sql import functions as F

from marketloom.operators import bars
from marketloom.sources import sinks
from marketloom.streaming.bars import stream_bars


def test_replace_append_swap(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "symbol string, v long")
    path = str(tmp_path / "t")
    sinks.append(df([("a", 1), ("b", 2)]), path)
    sinks.append(df([("a", 3)]), path)
    sinks.replace_keys(df([("a", 9)]), path)
    assert sorted((r.symbol, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]
    for v in (1, 2, 3):
        sinks.swap(df([("a", v)]), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).first().v == 3 and spark.read.parquet(str(tmp_path / "s_prev")).first().v == 2


def test_stream_gives_the_batch_bars(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("ab"[i % 2], start + dt.timedelta(minutes=17 * i), float(i * 7 % 31), i) for i in range(200)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, id long")
    ticks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = stream_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {(r.symbol, r.start): (r.open, r.high, r.low, r.close, r.n_bars) for r in spark.table("bars_out").collect()}
    want = bars.resample(ticks, bars.bucket("ts", "1 hour").alias("start"), "price", F.struct("ts", "id")).collect()
    assert got == {(r.symbol, r.start): (r.open, r.high, r.low, r.close, r.n_bars) for r in want}
