"""Streaming mirror of the batch bars (an addition: the reference has no streams).

Ticks become OHLC bars per event-time window; late ticks count until the
watermark passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """symbol, start, open, high, low, close, n_bars of a stream of symbol, ts, price, id."""
    order = F.struct("ts", "id")
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    out = rows.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("n_bars"))
    return out.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n_bars")
