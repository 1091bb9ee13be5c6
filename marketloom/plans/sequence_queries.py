"""Window operators and technical indicators."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import indicators as ind
from marketloom.plans import series_sql as ssql
from marketloom.plans.catalog import query, rounded
from marketloom.plans.relational_queries import BINS, RETURNS, binned, returns
from marketloom.sources import frames

D = f"with {frames.DAILY}"
W = "window w as (partition by symbol order by day)"


def last(n: int, value: str = "close", f: str = "avg") -> str:
    frame = f"over (partition by symbol order by day rows between {n - 1} preceding and current row)"
    return f"case when count({value}) {frame} = {n} then {f}({value}) {frame} end"


BASE = D + """, tr as (select *, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr, row_number() over w as k, close - coalesce(lag(close) over w, close) as d from daily
  window w as (partition by symbol order by day))"""


def ema_cte(name: str, src: str, value: str, alpha: str) -> str:
    """Recursive SQL of an exponential mean along k."""
    return f"""{name} as (select symbol, k, {value}::double as e from {src} where k = 1 union all
      select t.symbol, t.k, (1 - {alpha}) * p.e + {alpha} * t.{value} from {name} p join {src} t on t.symbol = p.symbol and t.k = p.k + 1)"""


RECURSIVE = BASE.replace("with ", "with recursive ", 1) + ", " + ", ".join(
    [
        "src as (select *, greatest(d, 0) as up, greatest(-d, 0) as down from tr)",
        ema_cte("e20", "src", "close", "(2.0::double / 21)"), ema_cte("e12", "src", "close", "(2.0::double / 13)"), ema_cte("e26", "src", "close", "(2.0::double / 27)"),
        ema_cte("a14", "src", "tr", "(1.0::double / 14)"), ema_cte("u14", "src", "up", "(1.0::double / 14)"), ema_cte("d14", "src", "down", "(1.0::double / 14)"),
        "line as (select symbol, k, x.e - y.e as line from e12 x join e26 y using (symbol, k))", ema_cte("s9", "line", "line", "(2.0::double / 10)"),
    ]
)


@query(
    "ind01_10_ema_rsi_atr_macd",
    RECURSIVE + """ select s.symbol, s.day, round(e20.e, 4) as ema20, round(case when s.k > 14 then 100 - 100 / (1 + u14.e / greatest(d14.e, 1e-12)) end, 4) as rsi14, round(case when s.k > 14 then a14.e end, 4) as atr14,
    round(line, 4) as macd, round(s9.e, 4) as macd_signal, round(line - s9.e, 4) as macd_rest from src s join e20 using (symbol, k) join a14 using (symbol, k) join u14 using (symbol, k) join d14 using (symbol, k) join line using (symbol, k) join s9 using (symbol, k)""",
)
def recursive_indicators(spark, sf):
    return rounded(ind.rsi_macd_atr(frames.daily(spark, sf)), 4)


@query("ind06_07_13_trend", ssql.trend(D))
def trend(spark, sf):
    return rounded(ind.trend(frames.daily(spark, sf)), 5)


@query(
    "ind02_14_channels",
    BASE + f""", c as (select symbol, day, close, tr, {last(20)} as sma20, {last(20)} - 2 * {last(20, f='stddev_pop')} as boll_low, {last(20)} + 2 * {last(20, f='stddev_pop')} as boll_high,
    {last(20, 'low', 'min')} as don_low, {last(20, 'high', 'max')} as don_high, 100 * (close - {last(14, 'low', 'min')}) / greatest({last(14, 'high', 'max')} - {last(14, 'low', 'min')}, 1e-12) as stoch_k,
    ({last(9, 'high', 'max')} + {last(9, 'low', 'min')}) / 2 as tenkan, ({last(26, 'high', 'max')} + {last(26, 'low', 'min')}) / 2 as kijun, ({last(52, 'high', 'max')} + {last(52, 'low', 'min')}) / 2 as span_b from tr)
    select symbol, day, round(tr, 6) as tr, round(sma20, 6) as sma20, round(boll_low, 4) as boll_low, round(boll_high, 4) as boll_high, round(don_low, 6) as don_low, round(don_high, 6) as don_high, round(stoch_k, 4) as stoch_k,
    round({last(3, 'stoch_k')}, 4) as stoch_d, tenkan, kijun, (tenkan + kijun) / 2 as span_a, span_b from c""".replace("round(tr, 6)", "tr").replace("round(don_low, 6)", "don_low").replace("round(don_high, 6)", "don_high"),
)
def channels(spark, sf):
    c = ind.channels(frames.daily(spark, sf))
    exact = ["tr", "don_low", "don_high", "tenkan", "kijun", "span_a", "span_b"]
    four, six = ["boll_low", "boll_high", "stoch_k", "stoch_d"], ["sma20"]
    return c.select("symbol", "day", *exact, *[F.round(x, 4).alias(x) for x in four], *[F.round(x, 6).alias(x) for x in six])


@query(
    "ind15_atr_percentile",
    BASE + """, h as (select symbol, day, tr, list(tr) over (partition by symbol order by day rows between 59 preceding and current row) as held from tr)
    select symbol, day, round(case when len(held) >= 30 then (len(list_filter(held, lambda x: x < tr)) + (len(list_filter(held, lambda x: x = tr)) + 1) / 2) / len(held) end, 6) as pct_rank from h""",
)
def atr_percentile(spark, sf):
    d = frames.daily(spark, sf).withColumn("tr", ind.true_range())
    return rounded(ind.percentile_rank(d, "tr", 60, 30).select("symbol", "day", "pct_rank"))


@query("ind16_rolling_vwap", D + f", m as (select *, (high + low + close) / 3 * volume as m from daily) select symbol, day, round({last(20, 'm', 'sum')} / nullif({last(20, 'volume', 'sum')}, 0), 5) as vwap from m")
def vwap(spark, sf):
    return rounded(ind.vwap(frames.daily(spark, sf), 20).select("symbol", "day", "vwap"), 5)


SWING = D + """, sw as (select *, count(*) over a = 5 and high = max(high) over a and len(list_filter(list(high) over a, lambda x: x = high)) = 1 as sh,
  count(*) over a = 5 and low = min(low) over a and len(list_filter(list(low) over a, lambda x: x = low)) = 1 as sl from daily window a as (partition by symbol order by day rows between 2 preceding and 2 following))"""


@query("ind17_swing_pivots", SWING + " select symbol, day, sh::integer as swing_high, sl::integer as swing_low from sw")
def swings(spark, sf):
    return ind.pivots(frames.daily(spark, sf)).select("symbol", "day", "swing_high", "swing_low")


@query("ind18_support_resistance", ssql.levels(SWING))
def levels(spark, sf):
    return rounded(ind.levels(frames.daily(spark, sf)), 5)


@query(
    "ind19_open_gaps",
    D + """, drift as (select symbol, day, high + 500 * k as high, low + 500 * k as low from (select *, row_number() over (partition by symbol order by day) as k from daily)), x as (select *, lag(high) over w as h0, lag(low) over w as l0, lead(high) over w as h2, lead(low) over w as l2, min(low) over f as ll, max(high) over f as hl from drift
      window w as (partition by symbol order by day), f as (partition by symbol order by day rows between 2 following and unbounded following)),
    g as (select symbol, day, case when l2 > h0 then 1 when h2 < l0 then -1 end as side, case when l2 > h0 then h0 else h2 end as bottom, case when l2 > h0 then l2 else l0 end as top, ll, hl from x),
    k as (select *, row_number() over (partition by symbol order by day desc) as k from g where side is not null and not coalesce(case when side = 1 then ll <= bottom else hl >= top end, false))
    select symbol, day, side, bottom, top from k where k <= 12""",
)
def open_gaps(spark, sf):
    # Prices here have no trend, which would close every gap; a drift leaves some open.
    drift = 500 * F.row_number().over(ind.w())
    return ind.open_gaps(frames.daily(spark, sf).withColumns({"high": F.col("high") + drift, "low": F.col("low") + drift}))


@query(
    "ind20_liquidity_sweeps",
    SWING + """, s as (select *, max(case when sh then high end) over p as top, min(case when sl then low end) over p as bottom from sw window p as (partition by symbol order by day rows between 60 preceding and 3 preceding))
    select symbol, day, top as level, -1 as side from s where high > top and close < top union all select symbol, day, bottom, 1 from s where low < bottom and close > bottom""",
)
def sweeps(spark, sf):
    return ind.sweeps(frames.daily(spark, sf))


@query(
    "ind23_candles",
    D + """, x as (select *, lag(open) over w as po, lag(close) over w as pc, lag(high) over w as ph, lag(low) over w as pl, lag(open, 2) over w as qo, lag(close, 2) over w as qc, greatest(high - low, 1e-12) as span, abs(close - open) as b from daily window w as (partition by symbol order by day))
    select symbol, day, round(b / span, 6) as body, coalesce(b <= 0.1 * span, false)::integer as doji, coalesce(close > open and pc < po and close >= po and open <= pc, false)::integer as engulfing_up,
    coalesce(close < open and pc > po and close <= po and open >= pc, false)::integer as engulfing_down,
    coalesce(close > open and pc < po and greatest(open, close) <= greatest(po, pc) and least(open, close) >= least(po, pc) and b < abs(pc - po), false)::integer as harami_up,
    coalesce(close < open and pc > po and greatest(open, close) <= greatest(po, pc) and least(open, close) >= least(po, pc) and b < abs(pc - po), false)::integer as harami_down,
    coalesce(high <= ph and low >= pl, false)::integer as inside_bar, coalesce(high >= ph and low <= pl, false)::integer as outside_bar, coalesce(close > open and pc > po and qc > qo, false)::integer as three_up, coalesce(low > ph, false)::integer as gap_up from x""",
)
def candles(spark, sf):
    c = ind.candles(frames.daily(spark, sf))
    return rounded(c.select("symbol", "day", "body", "doji", "engulfing_up", "engulfing_down", "harami_up", "harami_down", "inside_bar", "outside_bar", "three_up", "gap_up"))


@query("ind26_autocorrelation", RETURNS + """, p as (select *, lag(r) over (partition by symbol order by day) as b from ret) select symbol, day, round(case when count(case when r is not null and b is not null then 1 end) over w = 19 then corr(r, b) over w end, 5) as autocorr
    from p window w as (partition by symbol order by day rows between 18 preceding and current row)""")
def autocorr(spark, sf):
    return rounded(ind.autocorrelation(returns(spark, sf), "r", 20).select("symbol", "day", "autocorr"), 5)


@query("ind27_momentum", RETURNS + f", m as (select symbol, day, {last(20, 'r', 'sum')} as m from ret) select symbol, day, round(m, 6) as tsmom, sign(m)::integer as side from m")
def tsmom(spark, sf):
    return rounded(ind.momentum(frames.daily(spark, sf), 20).select("symbol", "day", "tsmom", "side"))


@query("ind25_exponential_sums", ssql.exponential_sums(RETURNS))
def exponential_sums(spark, sf):
    from marketloom.functions import recursive as rec

    r = returns(spark, sf).where("r is not null")
    return rounded(ind.per_symbol(r, ["r"], {"k10": "double", "k100": "double"}, lambda r: {"k10": rec.exponential_sum(r, 0.1), "k100": rec.exponential_sum(r, 0.01)}))


@query("win01_lag_lead", D + f" select symbol, day, close - lag(close) over w as diff, lead(close) over w as ahead, lag(close, 5) over w as week from daily {W}")
def lag_lead(spark, sf):
    w = ind.w()
    return frames.daily(spark, sf).select("symbol", "day", (F.col("close") - F.lag("close").over(w)).alias("diff"), F.lead("close").over(w).alias("ahead"), F.lag("close", 5).over(w).alias("week"))


@query("win02_rolling", D + """ select symbol, day, round(avg(close) over w, 6) as mean, round(stddev_samp(close) over w, 5) as sd, min(low) over w as least, max(high) over w as most, round(quantile_cont(close, 0.5) over w, 6) as median
    from daily window w as (partition by symbol order by day rows between 19 preceding and current row)""")
def rolling(spark, sf):
    o = ind.over(20)
    return frames.daily(spark, sf).select("symbol", "day", F.round(F.avg("close").over(o), 6).alias("mean"), F.round(F.stddev_samp("close").over(o), 5).alias("sd"), F.min("low").over(o).alias("least"), F.max("high").over(o).alias("most"), F.round(F.percentile("close", F.lit(0.5)).over(o), 6).alias("median"))


@query("win03_expanding_shifted", D + " select symbol, day, round(avg(close) over w, 6) as mean, round(stddev_samp(close) over w, 5) as sd from daily window w as (partition by symbol order by day rows between unbounded preceding and 1 preceding)")
def expanding(spark, sf):
    o = ind.w().rowsBetween(Window.unboundedPreceding, -1)
    return frames.daily(spark, sf).select("symbol", "day", F.round(F.avg("close").over(o), 6).alias("mean"), F.round(F.stddev_samp("close").over(o), 5).alias("sd"))


@query("win04_horizon_return", RETURNS + " select symbol, day, round(case when count(r) over w = 5 then sum(r) over w end, 6) as r5 from ret window w as (partition by symbol order by day rows between current row and 4 following)")
def horizon_return(spark, sf):
    o = ind.w().rowsBetween(0, 4)
    return rounded(returns(spark, sf).select("symbol", "day", F.when(F.count("r").over(o) == 5, F.sum("r").over(o)).alias("r5")))


@query("win05_lagged_label", BINS + " select symbol, day, bin, lag(bin, 5) over (partition by symbol order by day) as before from b")
def lagged_label(spark, sf):
    return binned(spark, sf).select("symbol", "day", "bin", F.lag("bin", 5).over(ind.w()).alias("before"))


@query("win06_shifted_zscore", D + " select symbol, day, round(case when count(close) over w = 250 then (close - avg(close) over w) / greatest(stddev_samp(close) over w, 1e-8) end, 5) as z from daily window w as (partition by symbol order by day rows between 250 preceding and 1 preceding)")
def zscore(spark, sf):
    o = ind.w().rowsBetween(-250, -1)
    z = (F.col("close") - F.avg("close").over(o)) / F.greatest(F.stddev_samp("close").over(o), F.lit(1e-8))
    return rounded(frames.daily(spark, sf).select("symbol", "day", F.when(F.count("close").over(o) == 250, z).alias("z")), 5)


@query("win07_08_calendar_flags", D + """ select symbol, day, (row_number() over (partition by symbol, date_trunc('month', day) order by day desc) <= 2)::integer as month_end, (isodow(day) = 5 and day(day) <= 7)::integer as first_friday from daily""")
def calendar_flags(spark, sf):
    k = F.row_number().over(Window.partitionBy("symbol", F.trunc("day", "month")).orderBy(F.col("day").desc()))
    return frames.daily(spark, sf).select("symbol", "day", (k <= 2).cast("int").alias("month_end"), ((F.dayofweek("day") == 6) & (F.dayofmonth("day") <= 7)).cast("int").alias("first_friday"))


@query("win09_event_lead_lag", D + f", {frames.CALENDAR}, e as (select symbol, day, (day in (select day from calendar))::integer as event from daily) select symbol, day, event, lead(event) over w as tomorrow, lag(event) over w as yesterday from e {W}")
def event_lead_lag(spark, sf):
    c = frames.calendar(spark, sf).select("day", F.lit(1).alias("hit")).distinct()
    e = frames.daily(spark, sf).join(c, "day", "left").select("symbol", "day", F.coalesce("hit", F.lit(0)).alias("event"))
    return e.select("symbol", "day", "event", F.lead("event").over(ind.w()).alias("tomorrow"), F.lag("event").over(ind.w()).alias("yesterday"))


@query("win10_rank_against_train", D + ", t as (select symbol, close as c, day from daily), u as (select symbol, day, close, sum(case when day < date '1999-10-13' then 1 else 0 end) over (partition by symbol order by close range between unbounded preceding and current row) as below, sum(case when day < date '1999-10-13' then 1 else 0 end) over (partition by symbol) as n from daily) select symbol, day, round(below / n, 6) as pct from u")
def rank_against_train(spark, sf):
    train = (F.col("day") < F.lit("1999-10-13").cast("date")).cast("int")
    w = Window.partitionBy("symbol")
    below = F.sum(train).over(w.orderBy("close").rangeBetween(Window.unboundedPreceding, 0))
    return rounded(frames.daily(spark, sf).select("symbol", "day", (below / F.sum(train).over(w)).alias("pct")))


@query("win11_13_cross_section", RETURNS + """ select symbol, day, rank() over (partition by day order by r) as place, round(r - avg(r) over d, 6) as demeaned, round((r - avg(r) over d) / nullif(stddev_samp(r) over d, 0), 5) as z, round((sum(r) over d - r) / nullif(count(r) over d - 1, 0), 6) as others
    from ret where r is not null window d as (partition by day)""")
def cross_section(spark, sf):
    d = Window.partitionBy("day")
    r = F.col("r")
    return returns(spark, sf).where("r is not null").select(
        "symbol", "day", F.rank().over(d.orderBy("r")).cast("long").alias("place"), F.round(r - F.avg("r").over(d), 6).alias("demeaned"),
        F.round((r - F.avg("r").over(d)) / F.nullif(F.stddev_samp("r").over(d), F.lit(0.0)), 5).alias("z"), F.round((F.sum("r").over(d) - r) / F.nullif(F.count("r").over(d) - 1, F.lit(0)), 6).alias("others"),
    )


@query("win14_state_code", BINS + " select symbol, day, (lag(bin, 1) over w + 3 * lag(bin, 2) over w + 9 * lag(bin, 3) over w)::integer as code from b " + W)
def state_code(spark, sf):
    return binned(spark, sf).select("symbol", "day", (F.lag("bin", 1).over(ind.w()) + 3 * F.lag("bin", 2).over(ind.w()) + 9 * F.lag("bin", 3).over(ind.w())).alias("code"))


@query("win15_normalised_subsequence", D + """, h as (select symbol, day, list(close) over (partition by symbol order by day rows between 7 preceding and current row) as x from daily) select symbol, day, list_transform(x, lambda v: round((v - list_avg(x)) / list_stddev_pop(x), 4)) as z from h where len(x) = 8""")
def subsequence(spark, sf):
    o = ind.over(8)
    rows = frames.daily(spark, sf).withColumns({"x": F.collect_list("close").over(o), "m": F.avg("close").over(o), "s": F.stddev_pop("close").over(o)}).where(F.size("x") == 8)
    z = F.transform("x", lambda v: F.when(F.col("s") == 0, F.lit(math.nan)).otherwise((v - F.col("m")) / F.col("s")))
    return rows.select("symbol", "day", F.transform(z, lambda v: F.abs(F.round(v, 4)) * F.signum(v)).alias("z"))  # what is just below zero rounds to -0.0


@query("win16_rolling_tail", RETURNS + """, h as (select symbol, day, quantile_cont(r, 0.05) over w as q, list(r) over w as x, count(r) over w as n from ret window w as (partition by symbol order by day rows between 250 preceding and 1 preceding))
    select symbol, day, round(case when n >= 100 then q end, 6) as q, round(case when n >= 100 then list_avg(list_filter(x, lambda v: v <= q)) end, 6) as es from h""")
def rolling_tail(spark, sf):
    o = ind.w().rowsBetween(-250, -1)
    rows = returns(spark, sf).withColumns({"q": F.percentile("r", F.lit(0.05)).over(o), "x": F.collect_list("r").over(o)})
    low = F.filter("x", lambda v: v <= F.col("q"))
    es = F.aggregate(low, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(low), F.lit(0))
    enough = F.size("x") >= 100
    return rounded(rows.select("symbol", "day", F.when(enough, F.col("q")).alias("q"), F.when(enough, es).alias("es")))


@query("win17_drawdown", RETURNS + ", c as (select symbol, day, sum(coalesce(r, 0)) over (partition by symbol order by day) as cum from ret) select symbol, day, round(max(cum) over (partition by symbol order by day) - cum, 6) as drawdown from c")
def drawdown(spark, sf):
    c = returns(spark, sf).withColumn("cum", F.sum(F.coalesce("r", F.lit(0.0))).over(ind.w()))
    return rounded(c.select("symbol", "day", (F.max("cum").over(ind.w()) - F.col("cum")).alias("drawdown")))


@query("win18_refit_blocks", D + ", k as (select symbol, day, row_number() over (partition by symbol order by day) - 1 as k from daily) select symbol, (k - 750) // 21 as block, min(day) as first_day, max(day) as last_day, count(*) as n from k where k >= 750 group by 1, 2")
def refit_blocks(spark, sf):
    k = F.row_number().over(ind.w()) - 1
    rows = frames.daily(spark, sf).withColumn("k", k).where("k >= 750").withColumn("block", F.floor((F.col("k") - 750) / 21))
    return rows.groupBy("symbol", "block").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query("win19_worst_of_path", RETURNS + """, h as (select symbol, day, list(r) over (partition by symbol order by day rows between 1 following and 5 following) as x from ret), p as (select symbol, day, list_min(list_transform(range(1, len(x) + 1), lambda i: list_sum(x[1:i]))) as worst from h where len(x) = 5) select symbol, day, round(worst, 6) as worst from p""")
def worst_of_path(spark, sf):
    rows = returns(spark, sf).withColumn("x", F.collect_list("r").over(ind.w().rowsBetween(1, 5))).where(F.size("x") == 5)
    start = F.struct(F.lit(0.0).alias("at"), F.lit(float("inf")).alias("worst"))
    worst = F.aggregate("x", start, lambda a, v: F.struct((a["at"] + v).alias("at"), F.least(a["worst"], a["at"] + v).alias("worst")), lambda a: a["worst"])
    return rounded(rows.select("symbol", "day", worst.alias("worst")))


@query("ind21_bundle_is_causal", ssql.causal_bundle(D))
def bundle(spark, sf):
    """Largest change of an indicator of the first rows when the last 40 rows go (0: causal)."""
    d = frames.daily(spark, sf)
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("day").desc()))
    cut = d.withColumn("back", back).where("back > 40").drop("back")
    a, b = ind.rsi_macd_atr(d), ind.rsi_macd_atr(cut)
    names = [c for c in a.columns if c not in ("symbol", "day")]
    both = a.join(b.select("symbol", "day", *[F.col(c).alias(f"{c}_cut") for c in names]), ["symbol", "day"])
    return rounded(both.groupBy("symbol").agg(*[F.max(F.abs(F.col(c) - F.col(f"{c}_cut"))).alias(c) for c in names]))


@query("ind22_hourly_features", f"""with {frames.HOURLY} select symbol, ts, round(case when count(close) over w = 24 then (close - avg(close) over w) / greatest(2 * stddev_pop(close) over w, 1e-12) end, 5) as pct_b, round(case when count(close) over w = 24 then (close - min(low) over w) / greatest(max(high) over w - min(low) over w, 1e-12) end, 6) as place
    from hourly window w as (partition by symbol order by ts rows between 23 preceding and current row)""")
def hourly_features(spark, sf):
    o = ind.over(24, "ts")
    full = F.count("close").over(o) == 24
    b = (F.col("close") - F.avg("close").over(o)) / F.greatest(2 * F.stddev_pop("close").over(o), F.lit(1e-12))
    place = (F.col("close") - F.min("low").over(o)) / F.greatest(F.max("high").over(o) - F.min("low").over(o), F.lit(1e-12))
    return frames.hourly(spark, sf).select("symbol", "ts", F.round(F.when(full, b), 5).alias("pct_b"), F.round(F.when(full, place), 6).alias("place"))
