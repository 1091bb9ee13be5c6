"""Files written from the supplied tables and read again: sinks and readers end to end.

Every run writes below a new folder of the place that driver and executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketloom.plans.catalog import query, rounded
from marketloom.session import shared_dir
from marketloom.sources import frames, readers, sinks

D, H = f"with {frames.DAILY}", f"with {frames.HOURLY}"
DAY = "date '1999-10-13'"


def fresh(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def bars_of(spark, sf):
    return frames.daily(spark, sf).select("symbol", "day", "close", "n_bars")


@query("snk01_append", D + " select symbol, day, close, n_bars from daily")
def append(spark, sf):
    """Two runs append to one table, partitioned by symbol."""
    path, rows = fresh(spark), bars_of(spark, sf)
    sinks.append(rows.where(f"day < {DAY}"), path)
    sinks.append(rows.where(f"day >= {DAY}"), path)
    return spark.read.parquet(path).select("symbol", "day", "close", "n_bars")


@query("snk02_replace_keys", D + f" select symbol, day, case when symbol = 'R' then -close else close end as close, n_bars from daily where symbol <> 'R' or day >= {DAY}")
def replace_keys(spark, sf):
    """A second write replaces one symbol's rows and leaves the others."""
    path, rows = fresh(spark), bars_of(spark, sf)
    sinks.append(rows, path)
    sinks.replace_keys(rows.where(f"symbol = 'R' and day >= {DAY}").withColumn("close", -F.col("close")), path)
    return spark.read.parquet(path).select("symbol", "day", "close", "n_bars")


@query("snk03_swap", D + f" select 'now' as version, count(*) as n, round(sum(close), 4) as total from daily where day >= {DAY} union all select 'before', count(*), round(sum(close), 4) from daily where day < {DAY}")
def swap(spark, sf):
    """A table swapped for a new one; the one before stays beside it."""
    path, rows = fresh(spark), bars_of(spark, sf)
    sinks.swap(rows.where(f"day < {DAY}"), path)
    sinks.swap(rows.where(f"day >= {DAY}"), path)
    card = lambda at, name: spark.read.parquet(at).agg(F.lit(name).alias("version"), F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"))
    return rounded(card(path, "now").unionByName(card(path + "_prev", "before")), 4)


REPORT = " select symbol, year(day)::integer as year, count(*) as days, round(avg(close), 4) as mean_close, nullif(max(n_bars), 999999) as most from daily group by 1, 2"


def report(spark, sf):
    g = frames.daily(spark, sf).groupBy("symbol", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.avg("close").alias("mean_close"), F.max("n_bars").alias("most"))
    return rounded(g, 4)


@query("snk05_report_csv", D + REPORT)
def report_csv(spark, sf):
    path = fresh(spark)
    sinks.export_csv(report(spark, sf), path)
    return spark.read.schema("symbol string, year int, days long, mean_close double, most long").csv(path, header=True)


@query("snk05_report_json", D + REPORT)
def report_json(spark, sf):
    path = fresh(spark)
    sinks.export_json(report(spark, sf), path)
    return spark.read.schema("symbol string, year int, days long, mean_close double, most long").json(path)


@query("src01_bars_csv", D + " select day::timestamp as ts, open, high, low, close, n_bars from daily")
def bars_csv(spark, sf):
    """Daily bars as CSV with a header, read by their fixed layout."""
    path, d = fresh(spark), frames.daily(spark, sf)
    d.select(F.date_format("day", "yyyy-MM-dd").alias("Date"), "open", "high", "low", "close", "n_bars").write.csv(path, header=True)
    return readers.bars_csv(spark, path).withColumn("ts", F.col("Date").cast("timestamp_ntz")).select("ts", "open", "high", "low", "close", "n_bars")


@query("src02_03_minute_lines", H + " select ts, open, high, low, close, n_bars::double as volume from hourly where low <= least(open, close) and high >= greatest(open, close)")
def minute_lines(spark, sf):
    """Bars as lines of three layouts, some of them broken, parsed into one table."""
    path, h = fresh(spark), frames.hourly(spark, sf)
    at = lambda f: F.date_format("ts", f)
    text = lambda sep, *first: F.concat_ws(sep, *first, *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "n_bars")])
    kind = F.pmod(F.xxhash64("symbol", "ts"), F.lit(3))
    line = F.when(kind == 0, text(";", at("yyyyMMdd HHmmss"))).when(kind == 1, text(",", at("yyyy.MM.dd"), at("HH:mm"))).otherwise(text(",", F.col("symbol"), at("yyyyMMdd"), at("HHmmss")))
    broken = F.when(F.col("n_bars") > 0, F.concat(F.lit("x,"), line))
    lines = h.select(F.explode(F.array_compact(F.array(line, F.when(kind == 0, F.lit("no bar")), F.when(kind == 1, F.substring(line, 1, 12)), F.when(kind == 0, broken)))).alias("value"))
    lines.write.text(path)
    return readers.parse_minutes(spark.read.text(path)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("src09_observations", f'with {frames.MONTHLY_RATE} select month as "DATE", rate::double as value from monthly_rate where cur < 3')
def observations(spark, sf):
    """A statistics office's CSV, where a dot stands for what is missing."""
    path, m = fresh(spark), frames.monthly_rate(spark, sf)
    value = F.when(F.col("cur") < 3, F.col("rate").cast("double").cast("string")).otherwise(".")
    m.select(F.date_format("month", "yyyy-MM-dd").alias("observation_date"), value.alias("RATE")).write.csv(path, header=True)
    return readers.observation_csv(spark, path)
