"""The supplied tables as market frames: ticks, bars, calendars.

Each frame is long, with a symbol column; nothing is kept per symbol.  The SQL
with the same rows, for checks, is beside each frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import bars


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, ts, price, id: one row per event."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("id"))


TICKS = "ticks as (select event_type as symbol, ts, value as price, event_id as id from events)"


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, day, price, weight, and the order of trades within a day."""
    t = table(spark, sf, "lineitem")
    return t.select(
        F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("weight"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"),
    )


TRADES = """trades as (select l_returnflag as symbol, l_shipdate::date as day, l_extendedprice / l_quantity as price, l_quantity as weight,
  l_orderkey, l_linenumber, l_partkey from lineitem)"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return bars.resample(ticks(spark, sf), bars.bucket("ts", "1 hour").alias("ts"), "price", F.struct("ts", "id"))


HOURLY = TICKS + """,
hourly as (select symbol, time_bucket(interval 1 hour, ts) as ts, arg_min(price, (ts, id)) as open, max(price) as high, min(price) as low,
  arg_max(price, (ts, id)) as close, count(*) as n_bars from ticks group by 1, 2)"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, day, open, high, low, close, n_bars, volume."""
    return bars.resample(trades(spark, sf), F.col("day"), "price", F.col("seq"), F.sum("weight").alias("volume"))


DAILY = TRADES + """,
daily as (select symbol, day, arg_min(price, (l_orderkey, l_linenumber, l_partkey)) as open, max(price) as high, min(price) as low,
  arg_max(price, (l_orderkey, l_linenumber, l_partkey)) as close, count(*) as n_bars, sum(weight) as volume from trades group by 1, 2)"""


def other_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of another source: order priorities."""
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    return bars.resample(rows, F.col("day"), "price", F.col("seq"))


OTHER_DAILY = """other_daily as (select o_orderpriority as symbol, o_orderdate::date as day, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high,
  min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close, count(*) as n_bars from orders group by 1, 2)"""


def calendar(spark: SparkSession, sf: str, least: float = 480_000.0) -> DataFrame:
    """day, code: days with a large order, by its priority."""
    o = table(spark, sf, "orders").where(F.col("o_totalprice") >= least)
    return o.select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("code")).distinct()


CALENDAR = "calendar as (select distinct o_orderdate::date as day, o_orderpriority as code from orders where o_totalprice >= 480000)"


def monthly_rate(spark: SparkSession, sf: str) -> DataFrame:
    """month, cur, rate: largest order price of customers by nation region."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    month = F.trunc(F.to_date("o_orderdate"), "month")
    return rows.groupBy(month.alias("month"), F.col("n_regionkey").alias("cur")).agg(F.max("o_totalprice").alias("rate"))


MONTHLY_RATE = """monthly_rate as (select date_trunc('month', o_orderdate)::date as month, n_regionkey as cur, max(o_totalprice) as rate
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)"""
