"""Bars from ticks, and what is measured inside bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def bucket(ts: str, width: str) -> Column:
    """Start of the bucket that holds ts; keeps the column's type."""
    return F.window(ts, width)["start"]


def resample(df: DataFrame, by: Column, price: str, order: Column, *more: Column, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """OHLC and row count per symbol and bucket, in one partial aggregation."""
    return df.groupBy(*keys, by).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.count(F.lit(1)).alias("n_bars"), *more,
    )


def rebar(df: DataFrame, by: Column, ts: str = "ts", least: int = 0) -> DataFrame:
    """Coarser bars of bars; buckets of fewer than `least` bars go."""
    out = df.groupBy("symbol", by).agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"),
        F.count(F.lit(1)).alias("n_hours"), F.sum("n_bars").alias("n_ticks"),
    )
    return out.where(F.col("n_hours") >= least) if least else out


def every(df: DataFrame, k: int, ts: str = "ts") -> DataFrame:
    """Bars of k consecutive bars by position."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(ts)) - 1
    return df.withColumn("block", F.floor(place / k).cast("long")).groupBy("symbol", "block").agg(
        F.min(ts).alias(ts), F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close")
    )


def log_return(price: str, window, eps: float = EPS) -> Column:
    """Log return on the row before in the window; prices at most 0 give null."""
    now, before = F.col(price), F.lag(price).over(window)
    return F.when((now > 0) & (before > 0), F.ln(now) - F.ln(before))


def realized(df: DataFrame, price: str = "close", ts: str = "ts", finite_sample: bool = False) -> DataFrame:
    """Per symbol and day: rv, rq, bpv, rsp, rsn, n from the day's own returns.

    bpv is without the factor n / (n - 1) unless finite_sample.
    """
    day = F.to_date(ts)
    w = Window.partitionBy("symbol", "day").orderBy(ts)
    rows = df.withColumn("day", day).withColumn("r", log_return(price, w)).withColumn("r1", F.lag("r").over(w))
    r, n = F.col("r"), F.count("r")
    bpv = math.pi / 2 * F.sum(F.abs(r) * F.abs(F.col("r1")))
    out = rows.groupBy("symbol", "day").agg(
        F.sum(r * r).alias("rv"), (n / 3 * F.sum(r * r * r * r)).alias("rq"),
        (bpv * n / F.nullif(n - 1, F.lit(0)) if finite_sample else bpv).alias("bpv"),
        F.sum(F.when(r > 0, r * r).otherwise(F.when(r.isNotNull(), 0.0))).alias("rsp"),
        F.sum(F.when(r < 0, r * r).otherwise(F.when(r.isNotNull(), 0.0))).alias("rsn"), n.alias("n"),
    )
    return out.where(F.col("n") > 0)


def realized_at(df: DataFrame, width: str, price: str = "price", order: Column | None = None) -> DataFrame:
    """Realized variance of last prices per bucket of a width, per day."""
    last = df.groupBy("symbol", bucket("ts", width).alias("ts")).agg(F.max_by(price, order if order is not None else F.col("ts")).alias("close"))
    return realized(last).select("symbol", "day", "rv", "n")


def signature(df: DataFrame, widths: tuple[str, ...], order: Column) -> DataFrame:
    """Mean realized variance per symbol by sampling width."""
    parts = [realized_at(df, w, order=order).withColumn("width", F.lit(w)) for w in widths]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("symbol").pivot("width", list(widths)).agg(F.avg("rv"))


def scale_to_finer(coarse: DataFrame, fine: DataFrame, per: int, least: int = 20) -> DataFrame:
    """Measures of finer bars where there are any, else those of coarse bars, scaled.

    The scale of each measure is its median ratio over the days that both have
    (1 with fewer than `least`).  The two semivariances are shared out of the
    scaled variance by the coarse ones, so their sum stays the variance.
    """
    names = ["rv", "rq", "bpv", "rsp", "rsn", "n"]
    f = fine.select("symbol", "day", *[F.col(c).alias(f"f_{c}") for c in names])
    rows = coarse.join(f, ["symbol", "day"], "left")
    ratio = lambda c: F.when(F.col(c) > EPS, F.col(f"f_{c}") / F.col(c))
    both = rows.where(F.col("f_rv").isNotNull() & (F.col("rv") > EPS))
    scale = both.groupBy("symbol").agg(*[F.when(F.count(ratio(c)) >= least, F.percentile(ratio(c), F.lit(0.5))).alias(f"k_{c}") for c in names[:3]])
    rows = rows.join(F.broadcast(scale), "symbol", "left")  # a row per symbol
    made = {c: F.coalesce(f"f_{c}", F.col(c) * F.coalesce(f"k_{c}", F.lit(1.0))) for c in names[:3]}
    share = F.coalesce(F.least(F.greatest(F.col("rsp") / F.greatest(F.col("rsp") + F.col("rsn"), F.lit(EPS)), F.lit(0.05)), F.lit(0.95)), F.lit(0.5))
    parts = [F.coalesce("f_rsp", made["rv"] * share).alias("rsp"), F.coalesce("f_rsn", made["rv"] * (1 - share)).alias("rsn")]
    return rows.select("symbol", "day", *[v.alias(c) for c, v in made.items()], *parts, F.coalesce("f_n", F.col("n") * per).cast("long").alias("n"), F.col("f_rv").isNull().alias("estimated"))


def concentration(df: DataFrame, top: tuple[int, ...] = (1, 12), price: str = "close", ts: str = "ts") -> DataFrame:
    """How much of a day's realized variance its largest returns hold, and their HHI."""
    w = Window.partitionBy("symbol", "day").orderBy(ts)
    rows = df.withColumn("day", F.to_date(ts)).withColumn("r", log_return(price, w)).where("r is not null").withColumn("q", F.col("r") * F.col("r"))
    rank = F.row_number().over(Window.partitionBy("symbol", "day").orderBy(F.col("q").desc(), ts))
    total = F.sum("q")
    rows = rows.withColumn("rank", rank)
    return rows.groupBy("symbol", "day").agg(
        F.try_divide(F.sum(F.col("q") * F.col("q")), total * total).alias("hhi"),
        *[F.try_divide(F.sum(F.when(F.col("rank") <= k, F.col("q"))), total).alias(f"top{k}") for k in top],
    )


def seasonality(df: DataFrame, slot: Column, price: str = "close", ts: str = "ts", least: int = 2) -> DataFrame:
    """Standard deviation of returns per slot of the day or week, over the mean of all slots."""
    w = Window.partitionBy("symbol", "day").orderBy(ts)
    rows = df.withColumn("day", F.to_date(ts)).withColumn("r", log_return(price, w)).where("r is not null").withColumn("slot", slot)
    s = rows.groupBy("symbol", "slot").agg(F.stddev_samp("r").alias("s"), F.count("r").alias("n")).where(F.col("n") >= least)
    return s.withColumn("factor", F.col("s") / F.avg("s").over(Window.partitionBy("symbol")))


def periodicity(df: DataFrame, slot: Column, least: int = 3, price: str = "close", ts: str = "ts") -> DataFrame:
    """Robust factor per slot: MAD / 0.6745 of its returns, normalised so that the mean of squares is 1."""
    w = Window.partitionBy("symbol", "day").orderBy(ts)
    rows = df.withColumn("day", F.to_date(ts)).withColumn("r", log_return(price, w)).where("r is not null").withColumn("slot", slot)
    mid = rows.withColumn("m", F.expr("percentile(r, 0.5) over (partition by symbol, slot)"))
    s = mid.groupBy("symbol", "slot").agg((F.percentile(F.abs(F.col("r") - F.col("m")), F.lit(0.5)) / 0.6745).alias("s"), F.count("r").alias("n"))
    s = s.withColumn("s", F.when(F.col("n") >= least, F.col("s")))
    s = s.withColumn("s", F.coalesce("s", F.expr("percentile(s, 0.5) over (partition by symbol)")))
    return s.withColumn("factor", F.col("s") / F.sqrt(F.avg(F.col("s") * F.col("s")).over(Window.partitionBy("symbol"))))


def jumps(df: DataFrame, k: float = 4.0, price: str = "close", ts: str = "ts") -> DataFrame:
    """Per day: variance in returns beyond k robust deviations of the day's returns, and the rest."""
    w = Window.partitionBy("symbol", "day").orderBy(ts)
    rows = df.withColumn("day", F.to_date(ts)).withColumn("r", log_return(price, w)).where("r is not null")
    rows = rows.withColumn("mad", F.expr("percentile(abs(r), 0.5) over (partition by symbol, day)") / 0.6745)
    jump = F.abs(F.col("r")) > k * F.col("mad")
    q = F.col("r") * F.col("r")
    return rows.groupBy("symbol", "day").agg(
        F.sum(F.when(jump, q).otherwise(0.0)).alias("jump"), F.sum(F.when(jump, 0.0).otherwise(q)).alias("continuous"), F.count_if(jump).alias("n_jumps")
    )


def estimators(df: DataFrame, ts: str = "day") -> DataFrame:
    """Per bar: squared close-to-close, Parkinson, Garman-Klass, Rogers-Satchell, and its return parts."""
    w = Window.partitionBy("symbol").orderBy(ts)
    o, h, l, c, p = F.ln("open"), F.ln("high"), F.ln("low"), F.ln("close"), F.ln(F.lag("close").over(w))
    return df.withColumns(
        {
            "r_on": o - p, "r_oc": c - o, "r_cc": c - p, "cc": F.pow(c - p, F.lit(2)), "parkinson": F.pow(h - l, F.lit(2)) / (4 * math.log(2)),
            "gk": 0.5 * F.pow(h - l, F.lit(2)) - (2 * math.log(2) - 1) * F.pow(c - o, F.lit(2)), "rs": (h - c) * (h - o) + (l - c) * (l - o),
        }
    )


def yang_zhang(df: DataFrame, n: int, ts: str = "day") -> DataFrame:
    """Yang-Zhang variance over n bars; null until n are there."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    w = Window.partitionBy("symbol").orderBy(ts).rowsBetween(-(n - 1), 0)
    yz = F.var_samp("r_on").over(w) + k * F.var_samp("r_oc").over(w) + (1 - k) * F.avg("rs").over(w)
    return estimators(df, ts).withColumn("yz", F.when(F.count("r_on").over(w) == n, yz))


def slippage(df: DataFrame, distances: tuple[float, ...], ts: str = "ts", minutes: int = 5) -> DataFrame:
    """Per day and stop distance: the first bar whose low is at or below
    open * (1 - distance), and how far its low, its close and the lowest low of
    the next bars lie below the stop, as shares of the open."""
    day = Window.partitionBy("symbol", "day").orderBy(ts)
    rows = df.withColumn("day", F.to_date(ts))
    rows = rows.withColumns({"start": F.first("open").over(day), "low_next": F.min("low").over(day.rowsBetween(0, minutes - 1))})
    rows = rows.withColumn("distance", F.explode(F.array(*[F.lit(d) for d in distances])))
    stop = F.col("start") * (1 - F.col("distance"))
    hit = rows.withColumn("stop", stop).where((F.col("low") <= F.col("stop")) & (F.col("start") > 0))
    first = hit.groupBy("symbol", "day", "distance").agg(F.min_by(F.struct(ts, "start", "stop", "low", "close", "low_next"), ts).alias("x"))
    part = lambda c: ((F.col("x.stop") - F.col(f"x.{c}")) / F.col("x.start")).alias(f"slip_{c}")
    return first.select("symbol", "day", "distance", F.col(f"x.{ts}").alias("hit_at"), part("low"), part("close"), part("low_next"))


def histogram_quantiles(df: DataFrame, value: str, width: float, keys: tuple[str, ...], probs: tuple[float, ...]) -> DataFrame:
    """Quantiles from a histogram of bins of a width: the middle of the first
    bin at which the cumulative count reaches the share."""
    bins = df.groupBy(*keys, F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    bins = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w)})
    picks = [F.min(F.when(F.col("upto") >= p * F.col("total"), (F.col("bin") + 0.5) * width)).alias(f"q{int(p * 100)}") for p in probs]
    return bins.groupBy(*keys).agg(F.max("total").alias("n"), *picks)


def best_shift(a: DataFrame, b: DataFrame, shifts: range, price: str = "close", ts: str = "ts") -> DataFrame:
    """Per symbol, the shift in hours of b that brings its prices closest to a (median distance)."""
    moved = b.withColumn("shift", F.explode(F.sequence(F.lit(shifts.start), F.lit(shifts.stop - 1))))
    moved = moved.select("symbol", F.expr(f"{ts} + make_interval(0, 0, 0, 0, shift, 0, 0)").alias(ts), F.col(price).alias("other"), "shift")
    score = a.join(moved, ["symbol", ts]).groupBy("symbol", "shift").agg(F.percentile(F.abs(F.col(price) - F.col("other")), F.lit(0.5)).alias("d"))
    return score.groupBy("symbol").agg(F.min_by("shift", F.struct("d", "shift")).alias("shift"), F.min("d").alias("distance"))
