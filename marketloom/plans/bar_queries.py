"""Sources, data quality, bars, realized measures and per-bar estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import bars, quality
from marketloom.plans.catalog import query, rounded
from marketloom.sources import frames, readers

RET = """ret as (select *, symbol as s, ts::date as day, case when close > 0 and lag(close) over w > 0 then ln(close) - ln(lag(close) over w) end as r
  from hourly window w as (partition by symbol, ts::date order by ts))"""
RET2 = RET + ", ret2 as (select *, lag(r) over (partition by symbol, day order by ts) as r1 from ret)"


@query("rsm01_hourly_bars", f"with {frames.HOURLY} select * from hourly")
def hourly_bars(spark, sf):
    return frames.hourly(spark, sf)


@query(
    "rsm02_daily_from_hourly",
    f"""with {frames.HOURLY} select symbol, ts::date as day, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close,
    count(*) as n_hours, cast(sum(n_bars) as bigint) as n_ticks from hourly group by 1, 2 having count(*) >= 3""",
)
def daily_from_hourly(spark, sf):
    return bars.rebar(frames.hourly(spark, sf), F.to_date("ts").alias("day"), least=3)


@query("rsm02_daily_bars", f"with {frames.DAILY} select * from daily")
def daily_bars(spark, sf):
    return frames.daily(spark, sf)


@query(
    "rsm03_five_minute_bars",
    f"with {frames.TICKS} select symbol, time_bucket(interval 5 minute, ts) as ts, arg_min(price, (ts, id)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, id)) as close, count(*) as n_bars from ticks group by symbol, time_bucket(interval 5 minute, ts)",
)
def five_minute_bars(spark, sf):
    return bars.resample(frames.ticks(spark, sf), bars.bucket("ts", "5 minutes").alias("ts"), "price", F.struct("ts", "id"))


@query(
    "rsm04_every_four_bars",
    f"""with {frames.HOURLY}, p as (select *, (row_number() over (partition by symbol order by ts) - 1) // 4 as block from hourly)
    select symbol, block, min(ts) as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close from p group by 1, 2""",
)
def every_four(spark, sf):
    return bars.every(frames.hourly(spark, sf), 4)


REALIZED = f"""with {frames.HOURLY}, {RET2}
    select symbol, day, round(sum(r * r), 6) as rv, round(count(r) / 3 * sum(r * r * r * r), 6) as rq,
      round(pi() / 2 * sum(abs(r) * abs(r1)){{}}, 6) as bpv, round(sum(case when r > 0 then r * r when r is not null then 0 end), 6) as rsp,
      round(sum(case when r < 0 then r * r when r is not null then 0 end), 6) as rsn, count(r) as n
    from ret2 group by 1, 2 having count(r) > 0"""


@query("realized_measures", REALIZED.format(""))
def realized_measures(spark, sf):
    return rounded(bars.realized(frames.hourly(spark, sf)))


@query("rsm09_bipower_finite_sample", REALIZED.format(" * count(r) / nullif(count(r) - 1, 0)"))
def bipower(spark, sf):
    return rounded(bars.realized(frames.hourly(spark, sf), finite_sample=True))


def _rv_at(width: str) -> str:
    return f"""select symbol, day, sum(r * r) as rv, count(r) as n from (select symbol, ts::date as day, case when close > 0 and lag(close) over w > 0 then ln(close) - ln(lag(close) over w) end as r
      from (select symbol, time_bucket(interval {width}, ts) as ts, arg_max(price, (ts, id)) as close from ticks group by symbol, time_bucket(interval {width}, ts)) b
      window w as (partition by symbol, ts::date order by ts)) group by 1, 2 having count(r) > 0"""


@query("rsm05_06_realized_variance_15min", f"with {frames.TICKS} select symbol, day, round(rv, 6) as rv, n from ({_rv_at('15 minute')})")
def rv15(spark, sf):
    return rounded(bars.realized_at(frames.ticks(spark, sf), "15 minutes", order=F.struct("ts", "id")))


@query(
    "rsm07_volatility_signature",
    f"""with {frames.TICKS} select a.symbol, a.rv as "5 minutes", b.rv as "15 minutes", c.rv as "1 hour" from
    (select symbol, round(avg(rv), 6) as rv from ({_rv_at('5 minute')}) group by 1) a join (select symbol, round(avg(rv), 6) as rv from ({_rv_at('15 minute')}) group by 1) b using (symbol)
    join (select symbol, round(avg(rv), 6) as rv from ({_rv_at('1 hour')}) group by 1) c using (symbol)""",
)
def signature(spark, sf):
    return rounded(bars.signature(frames.ticks(spark, sf), ("5 minutes", "15 minutes", "1 hour"), F.struct("ts", "id")))


@query(
    "rsm13_concentration",
    f"""with {frames.HOURLY}, {RET}, q as (select symbol, day, r * r as q, row_number() over (partition by symbol, day order by r * r desc, ts) as k from ret where r is not null)
    select symbol, day, round(sum(q * q) / nullif(sum(q) * sum(q), 0), 6) as hhi, round(sum(case when k <= 1 then q end) / nullif(sum(q), 0), 6) as top1,
    round(sum(case when k <= 12 then q end) / nullif(sum(q), 0), 6) as top12 from q group by 1, 2""",
)
def concentration(spark, sf):
    return rounded(bars.concentration(frames.hourly(spark, sf)))


@query(
    "rsm14_periodicity_factor",
    f"""with {frames.HOURLY}, {RET}, x as (select symbol, hour(ts) as slot, r from ret where r is not null),
    m as (select *, quantile_cont(r, 0.5) over (partition by symbol, slot) as m from x),
    s as (select symbol, slot, quantile_cont(abs(r - m), 0.5) / 0.6745 as s, count(*) as n from m group by 1, 2),
    t as (select symbol, slot, n, case when n >= 3 then s end as s from s),
    u as (select symbol, slot, n, coalesce(s, quantile_cont(s, 0.5) over (partition by symbol)) as s from t)
    select symbol, cast(slot as integer) as slot, round(s, 6) as s, n, round(s / sqrt(avg(s * s) over (partition by symbol)), 6) as factor from u""",
)
def periodicity(spark, sf):
    return rounded(bars.periodicity(frames.hourly(spark, sf), F.hour("ts")))


@query(
    "rsm15_jump_split",
    f"""with {frames.HOURLY}, {RET}, x as (select symbol, day, r, quantile_cont(abs(r), 0.5) over (partition by symbol, day) / 0.6745 as mad from ret where r is not null)
    select symbol, day, round(sum(case when abs(r) > 4 * mad then r * r else 0 end), 6) as jump, round(sum(case when abs(r) > 4 * mad then 0 else r * r end), 6) as continuous,
    count(*) filter (abs(r) > 4 * mad) as n_jumps from x group by 1, 2""",
)
def jump_split(spark, sf):
    return rounded(bars.jumps(frames.hourly(spark, sf)))


@query(
    "rsm16_hour_seasonality",
    f"""with {frames.HOURLY}, {RET}, s as (select symbol, hour(ts) as slot, stddev_samp(r) as s, count(r) as n from ret where r is not null group by 1, 2 having count(r) >= 2)
    select symbol, cast(slot as integer) as slot, round(s, 6) as s, n, round(s / avg(s) over (partition by symbol), 6) as factor from s""",
)
def seasonality(spark, sf):
    return rounded(bars.seasonality(frames.hourly(spark, sf), F.hour("ts")))


@query(
    "rsm17_daily_hourly_consistency",
    f"""with {frames.HOURLY}, d as (select symbol, ts::date as day, arg_max(price, (ts, id)) as close, max(price) as high, min(price) as low from ticks group by 1, 2),
    h as (select symbol, ts::date as day, arg_max(close, ts) as c, max(high) as hi, min(low) as lo from hourly group by 1, 2)
    select symbol, round(max(abs(close - c)), 6) as worst, round(avg(case when high = hi then 1.0 else 0.0 end)::double, 6) as same_high, round(avg(case when low = lo then 1.0 else 0.0 end)::double, 6) as same_low
    from d join h using (symbol, day) group by 1""",
)
def consistency(spark, sf):
    d = bars.resample(frames.ticks(spark, sf), F.to_date("ts").alias("day"), "price", F.struct("ts", "id"))
    h = bars.rebar(frames.hourly(spark, sf), F.to_date("ts").alias("day")).select("symbol", "day", F.col("close").alias("c"), F.col("high").alias("hi"), F.col("low").alias("lo"))
    same = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("double"))
    return rounded(d.join(h, ["symbol", "day"]).groupBy("symbol").agg(F.max(F.abs(F.col("close") - F.col("c"))).alias("worst"), same("high", "hi").alias("same_high"), same("low", "lo").alias("same_low")))


EST = f"""with {frames.DAILY}, e as (select *, ln(open) - ln(lag(close) over w) as r_on, ln(close) - ln(open) as r_oc, ln(close) - ln(lag(close) over w) as r_cc,
    (ln(high) - ln(low)) ** 2 / (4 * ln(2)) as parkinson, 0.5 * (ln(high) - ln(low)) ** 2 - (2 * ln(2) - 1) * (ln(close) - ln(open)) ** 2 as gk,
    (ln(high) - ln(close)) * (ln(high) - ln(open)) + (ln(low) - ln(close)) * (ln(low) - ln(open)) as rs from daily window w as (partition by symbol order by day))"""


@query("vol01_07_estimators", EST + " select symbol, day, round(r_on, 6) as r_on, round(r_oc, 6) as r_oc, round(r_cc, 6) as r_cc, round(r_cc ** 2, 6) as cc, round(parkinson, 6) as parkinson, round(gk, 6) as gk, round(rs, 6) as rs from e")
def estimators(spark, sf):
    return rounded(bars.estimators(frames.daily(spark, sf)).select("symbol", "day", "r_on", "r_oc", "r_cc", "cc", "parkinson", "gk", "rs"))


@query(
    "vol08_yang_zhang",
    EST + """ select symbol, day, round(case when count(r_on) over w = 20 then var_samp(r_on) over w + (0.34 / (1.34 + 21.0 / 19.0)) * var_samp(r_oc) over w
    + (1 - 0.34 / (1.34 + 21.0 / 19.0)) * avg(rs) over w end, 6) as yz from e window w as (partition by symbol order by day rows between 19 preceding and current row)""",
)
def yang_zhang(spark, sf):
    return rounded(bars.yang_zhang(frames.daily(spark, sf), 20).select("symbol", "day", "yz"))


@query(
    "vol09_10_estimator_fit",
    EST + """ select symbol, round(corr(parkinson, gk), 6) as pk_gk, round(corr(parkinson, rs), 6) as pk_rs, round(avg(ln(greatest(parkinson, 1e-12)) - ln(greatest(r_cc ** 2, 1e-12))), 6) as log_ratio,
    round(var_samp(r_on) / (var_samp(r_on) + var_samp(r_oc)), 6) as overnight_share from e where r_cc is not null group by 1""",
)
def estimator_fit(spark, sf):
    e = bars.estimators(frames.daily(spark, sf)).where("r_cc is not null")
    log = lambda c: F.ln(F.greatest(F.col(c), F.lit(1e-12)))
    on, oc = F.var_samp("r_on"), F.var_samp("r_oc")
    return rounded(e.groupBy("symbol").agg(F.corr("parkinson", "gk").alias("pk_gk"), F.corr("parkinson", "rs").alias("pk_rs"), F.avg(log("parkinson") - log("cc")).alias("log_ratio"), (on / (on + oc)).alias("overnight_share")))


@query(
    "rsm18_overnight_monday",
    EST + """ select symbol, round(var_samp(case when isodow(day) = 1 then r_on end), 6) as monday, round(var_samp(case when isodow(day) <> 1 then r_on end), 6) as others from e group by 1""",
)
def overnight_monday(spark, sf):
    e = bars.estimators(frames.daily(spark, sf))
    monday = F.dayofweek("day") == 2
    return rounded(e.groupBy("symbol").agg(F.var_samp(F.when(monday, F.col("r_on"))).alias("monday"), F.var_samp(F.when(~monday, F.col("r_on"))).alias("others")))


@query(
    "rsm19_spread_histogram",
    """with b as (select event_type as symbol, hour(ts) as hour, floor(value / 0.5)::bigint as bin, count(*) as n from events group by 1, 2, 3),
    c as (select *, sum(n) over (partition by symbol, hour order by bin) as upto, sum(n) over (partition by symbol, hour) as total from b)
    select symbol, cast(hour as integer) as hour, cast(max(total) as bigint) as n, min(case when upto >= 0.5 * total then (bin + 0.5) * 0.5 end)::double as q50, min(case when upto >= 0.95 * total then (bin + 0.5) * 0.5 end)::double as q95
    from c group by 1, 2""",
)
def spread_histogram(spark, sf):
    t = frames.ticks(spark, sf).withColumn("hour", F.hour("ts"))
    return bars.histogram_quantiles(t, "price", 0.5, ("symbol", "hour"), (0.5, 0.95))


@query(
    "rsm20_matched_spread",
    f"""with {frames.HOURLY} select a.ts, round(a.close - b.close, 6) as spread from hourly a join hourly b on a.ts = b.ts and a.symbol = 'click' and b.symbol = 'error'""",
)
def matched_spread(spark, sf):
    h = frames.hourly(spark, sf)
    b = h.where("symbol = 'error'").select("ts", F.col("close").alias("bid"))
    return rounded(h.where("symbol = 'click'").join(b, "ts").select("ts", (F.col("close") - F.col("bid")).alias("spread")))


@query(
    "rsm21_shift_calibration",
    f"""with {frames.HOURLY}, m as (select symbol, ts + interval 1 hour * s as ts, close as other, s as shift from hourly, range(-6, 7) r(s)),
    d as (select a.symbol, shift, quantile_cont(abs(a.close - other), 0.5) as d from hourly a join m using (symbol, ts) group by 1, 2)
    select symbol, cast(arg_min(shift, (d, shift)) as integer) as shift, round(min(d), 6) as distance from d group by 1""",
)
def shift_calibration(spark, sf):
    h = frames.hourly(spark, sf)
    return rounded(bars.best_shift(h, h, range(-6, 7)))


@query(
    "rsm22_stop_slippage",
    f"""with {frames.HOURLY}, x as (select *, ts::date as day, first_value(open) over w as start, min(low) over (partition by symbol, ts::date order by ts rows between current row and 4 following) as low_next
      from hourly window w as (partition by symbol, ts::date order by ts)),
    h as (select *, start * (1 - d) as stop from x, (values (0.01), (0.05), (0.2)) v(d) where low <= start * (1 - d) and start > 0),
    f as (select *, row_number() over (partition by symbol, day, d order by ts) as k from h)
    select symbol, day, d::double as distance, ts as hit_at, round((stop - low) / start, 6) as slip_low, round((stop - close) / start, 6) as slip_close, round((stop - low_next) / start, 6) as slip_low_next from f where k = 1""",
)
def stop_slippage(spark, sf):
    return rounded(bars.slippage(frames.hourly(spark, sf), (0.01, 0.05, 0.2)))


@query(
    "rsm23_splice_quality",
    f"""with {frames.DAILY}, p as (select a.day, a.close as x, b.close as y from daily a join daily b on a.day = b.day and a.symbol = 'A' and b.symbol = 'R')
    select round(quantile_cont(abs(x - y), 0.5), 6) as median, round(avg(abs(x - y)), 6) as mean, round(quantile_cont(abs(x - y), 0.95), 6) as p95, round(max(abs(x - y)), 6) as worst, round(corr(x, y), 6) as corr, count(*) as n from p""",
)
def splice_quality(spark, sf):
    d = frames.daily(spark, sf)
    p = d.where("symbol = 'A'").select("day", F.col("close").alias("x")).join(d.where("symbol = 'R'").select("day", F.col("close").alias("y")), "day")
    e = F.abs(F.col("x") - F.col("y"))
    return rounded(p.agg(F.percentile(e, F.lit(0.5)).alias("median"), F.avg(e).alias("mean"), F.percentile(e, F.lit(0.95)).alias("p95"), F.max(e).alias("worst"), F.corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n")))


@query(
    "flt01_02_validity",
    f"""with {frames.DAILY} select symbol, count(*) as n, count(*) filter ((high < greatest(open, close) - 1e-9) or (low > least(open, close) + 1e-9) or (high < low - 1e-9)) as n_invalid,
    count(*) filter (high = low) as n_flat, count(*) - count(distinct day) as n_repeated from daily group by 1""",
)
def validity(spark, sf):
    return quality.validity(frames.daily(spark, sf))


GAP = "g as (select *, date_diff('day', lag(day) over (partition by symbol order by day), day) as gap from {})"


@query(
    "flt03_gap_histogram",
    f"""with {frames.OTHER_DAILY}, {GAP.format('other_daily')} select symbol, count(*) filter (gap = 1) as gap1, count(*) filter (gap = 2) as gap2, count(*) filter (gap = 3) as gap3, count(*) filter (gap between 4 and 7) as gap4_7,
    count(*) filter (gap > 7) as gap_more, cast(max(gap) as integer) as longest, arg_max(day, (gap, day)) filter (gap is not null) as longest_to from g group by 1""",
)
def gap_histogram(spark, sf):
    return quality.gaps(frames.other_daily(spark, sf))


@query(
    "flt04_range_against_mean",
    f"""with {frames.DAILY}, s as (select symbol, day, (high - low) / close as size from daily), t as (select *, avg(size) over w as m, count(size) over w as n from s window w as (partition by symbol order by day rows between 250 preceding and 1 preceding))
    select symbol, day, round(size, 6) as size, round(case when n = 250 then size / nullif(m, 0) end, 6) as ratio from t""",
)
def range_against_mean(spark, sf):
    return rounded(quality.range_against_before(frames.daily(spark, sf)).select("symbol", "day", "size", "ratio"))


@query(
    "flt05_bars_per_weekday",
    f"""with {frames.HOURLY}, d as (select symbol, ts::date as day, count(*) as n, min(hour(ts)) as first_hour, max(hour(ts)) as last_hour from hourly group by 1, 2)
    select symbol, cast(isodow(day) % 7 + 1 as integer) as weekday, count(*) as days, cast(sum(n) as bigint) as bars, cast(min(first_hour) as integer) as earliest, cast(max(last_hour) as integer) as latest from d group by 1, 2""",
)
def bars_per_weekday(spark, sf):
    d = frames.hourly(spark, sf).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(F.hour("ts")).alias("a"), F.max(F.hour("ts")).alias("b"))
    return d.groupBy("symbol", F.dayofweek("day").alias("weekday")).agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("bars"), F.min("a").alias("earliest"), F.max("b").alias("latest"))


ISLANDS = f"""with {frames.OTHER_DAILY}, {GAP.format('other_daily')}, i as (select symbol, day, sum(case when gap > 4 then 1 else 0 end) over (partition by symbol order by day) as island from g),
    k as (select symbol, day, cast(island as bigint) as island, row_number() over (partition by symbol, island order by day) as run from i)"""


@query("flt06_run_length", ISLANDS + " select symbol, day, island, run from k")
def run_length(spark, sf):
    return quality.runs(frames.other_daily(spark, sf)).select("symbol", "day", "island", F.col("run").cast("long").alias("run"))


@query("flt07_contiguous_rows", ISLANDS + " select symbol, count(*) filter (run >= 5) as usable, max(run) as longest, arg_max(day, (run, day)) as ends from k group by 1")
def contiguous(spark, sf):
    r = quality.runs(frames.other_daily(spark, sf))
    return r.groupBy("symbol").agg(F.count_if(F.col("run") >= 5).alias("usable"), F.max("run").cast("long").alias("longest"), F.max_by("day", F.struct("run", "day")).alias("ends"))


@query(
    "flt08_thin_day_merge",
    f"""with {frames.DAILY}, p as (select *, lag(n_bars) over w as pn, lag(day) over w as pd, lag(open) over w as po, lag(high) over w as ph, lag(low) over w as pl, lag(volume) over w as pv from daily window w as (partition by symbol order by day)),
    f as (select *, coalesce(pn < 5 and day - pd <= 3, false) as folds from p where n_bars >= 5)
    select symbol, day, case when folds then po else open end as open, case when folds then greatest(high, ph) else high end as high, case when folds then least(low, pl) else low end as low,
    close, cast(case when folds then n_bars + pn else n_bars end as bigint) as n_bars, case when folds then volume + pv else volume end as volume, cast(folds as integer) as folded from f""",
)
def thin_days(spark, sf):
    return quality.merge_thin(frames.daily(spark, sf), "n_bars", 5, ("n_bars", "volume"))


@query(
    "flt09_patch_from_cross",
    f"""with {frames.DAILY}, {frames.OTHER_DAILY}, base as (select day, open, close, high, low from other_daily where symbol = '1-URGENT'),
    x as (select a.day, a.open * b.open as open, a.close * b.close as close from daily a join daily b on a.day = b.day and a.symbol = 'A' and b.symbol = 'R')
    select day, open, close, high, low, 0 as is_patched from base union all
    select day, open, close, greatest(open, close), least(open, close), 1 from x where day between (select min(day) from base) and (select max(day) from base) and day not in (select day from base)""",
)
def patch(spark, sf):
    d, o = frames.daily(spark, sf), frames.other_daily(spark, sf)
    return quality.patch_from_cross(o.where("symbol = '1-URGENT'"), d.where("symbol = 'A'"), d.where("symbol = 'R'"))


@query("flt10_split_label", f"with {frames.DAILY} select symbol, case when day < date '1999-10-13' then 0 when day < date '2000-11-20' then 1 else 2 end as split, count(*) as n, min(day) as first_day, max(day) as last_day from daily group by 1, 2")
def split_label(spark, sf):
    d = frames.daily(spark, sf).withColumn("split", quality.split_label("day", "1999-10-13", "2000-11-20"))
    return d.groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(
    "flt11_estimated_guard",
    f"""with {frames.DAILY}, b as (select symbol, n_bars < 3 as est, row_number() over (partition by symbol order by day desc) as back from daily),
    t as (select symbol, coalesce(min(case when est then back end) - 1, count(*)) as true_rows from b group by 1)
    select symbol, cast(true_rows as bigint) as true_rows, case when true_rows < 22 then 'block' when true_rows < 37 then 'warn' else 'ok' end as status from t""",
)
def estimated_guard(spark, sf):
    return quality.true_run(frames.daily(spark, sf).withColumn("flag", (F.col("n_bars") < 3).cast("int")), "flag")


@query(
    "flt12_freshness",
    f"""with {frames.DAILY}, n as (select symbol, max(day) as new_end, count(*) as rows from daily where day <= date '2001-10-01' or symbol = 'A' group by 1), o as (select symbol, max(day) as old_end from daily where day <= date '2001-10-15' group by 1)
    select symbol, old_end, new_end, rows, coalesce(rows >= 5 and (old_end is null or new_end >= old_end), false) as fresh from o full join n using (symbol)""",
)
def freshness(spark, sf):
    d = frames.daily(spark, sf)
    return quality.freshness(d.where("day <= date '2001-10-01' or symbol = 'A'"), d.where("day <= date '2001-10-15'"))


@query("flt13_exclusion_window", f"with {frames.DAILY} select symbol, count(*) as n, round(stddev_samp(close), 6) as sd from daily where not day between date '1998-01-14' and date '1998-04-08' group by 1")
def exclusion(spark, sf):
    d = frames.daily(spark, sf).where(~F.col("day").between(F.lit("1998-01-14").cast("date"), F.lit("1998-04-08").cast("date")))
    return rounded(d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("close").alias("sd")))


@query(
    "flt14_intraday_shock",
    f"""with {frames.HOURLY}, d as (select symbol, ts::date as day, arg_max(close, ts) as p_now, arg_min(open, ts) as p_ref from hourly where close > 0 and open > 0 group by 1, 2), s as (select symbol, stddev_samp(ln(p_now / p_ref)) as sigma from d group by 1)
    select symbol, day, round(abs(ln(p_now / p_ref) / sigma), 6) as shock, abs(ln(p_now / p_ref) / sigma) > 1.5 as flagged from d join s using (symbol)""",
)
def shock(spark, sf):
    d = frames.hourly(spark, sf).where("close > 0 and open > 0").groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("now"), F.min_by("open", "ts").alias("ref"))
    r = F.ln(F.col("now") / F.col("ref"))
    s = d.groupBy("symbol").agg(F.stddev_samp(r).alias("sigma"))
    z = F.abs(r / F.col("sigma"))
    return rounded(d.join(s, "symbol").select("symbol", "day", z.alias("shock"), (z > 1.5).alias("flagged")))


@query(
    "flt15_anomalies_near_events",
    f"""with {frames.DAILY}, {frames.CALENDAR}, r as (select symbol, day, round(ln(close) - ln(lag(close) over (partition by symbol order by day)), 6) as r from daily)
    select symbol, day, r, coalesce(string_agg(distinct code, ',' order by code), '') as codes from r left join calendar c on c.day between r.day - 1 and r.day + 1 where abs(r) > 0.8 group by symbol, r.day, r""".replace("select symbol, day, r, coal", "select symbol, r.day as day, r, coal"),
)
def anomalies(spark, sf):
    d = rounded(bars.estimators(frames.daily(spark, sf)).select("symbol", "day", F.col("r_cc").alias("r")))
    return quality.anomalies(d, "r", 0.8, frames.calendar(spark, sf))


@query("flt16_weekend_gap", f"with {frames.OTHER_DAILY}, {GAP.format('other_daily')} select symbol, count(*) filter (gap >= 3) as weekends, count(*) as n from g group by 1")
def weekends(spark, sf):
    d = frames.other_daily(spark, sf).withColumn("gap", F.datediff("day", F.lag("day").over(quality.by_symbol())))
    return d.groupBy("symbol").agg(F.count_if(F.col("gap") >= 3).alias("weekends"), F.count(F.lit(1)).alias("n"))


@query(
    "prj01_04_pips_and_sessions",
    f"""with {frames.OTHER_DAILY} select case when symbol like '%HIGH%' then 'USDJPY' else 'EURUSD' end as pair, day, close / 1000::double * 0.001::double / (case when symbol like '%HIGH%' then 0.01 else 0.0001 end)::double as pips,
    cast(day + case isodow(day) when 5 then 3 when 6 then 2 else 1 end as date) as next_day, case when symbol like '%HIGH%' then -1 / close else close end as direction, 'live' as source from other_daily""",
)
def pips(spark, sf):
    d = frames.other_daily(spark, sf).withColumn("pair", F.when(F.col("symbol").contains("HIGH"), "USDJPY").otherwise("EURUSD"))
    direction = F.when(F.col("pair").endswith("JPY"), -1 / F.col("close")).otherwise(F.col("close"))
    return d.select("pair", "day", (F.col("close") / 1000.0 * 0.001 / quality.pip_size("pair")).alias("pips"), quality.next_session("day").alias("next_day"), direction.alias("direction"), F.lit("live").alias("source"))


@query("snk04_null_safe_json", "select event_id, '{\"id\":' || event_id || coalesce(',\"v\":' || case when isnan(x) or isinf(x) then null else cast(x as varchar) end, '') || '}' as json from (select event_id, case when event_id % 3 = 0 then 'nan'::double when event_id % 3 = 1 then 'inf'::double else 0.5 end as x from events)")
def json_safe(spark, sf):
    x = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 1, F.lit(float("inf"))).otherwise(F.lit(0.5))
    safe = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return frames.table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), safe.alias("v"))).alias("json"))


@query(
    "src12_article_text",
    r"""with a as (select page_id, html, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) as x from pages), b as (select page_id, case when length(x) > 0 then x else html end as x from a),
    c as (select page_id, regexp_replace(regexp_replace(x, '(?is)<(script|style|nav|figure)[^>]*>.*?</(script|style|nav|figure)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') as x from b),
    d as (select page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as x from c),
    e as (select page_id, trim(regexp_replace(x, '[ \t\r\n\f]+', ' ', 'g')) as x from d) select page_id, case when length(x) >= 200 then md5(x) end as text_md5, case when length(x) >= 200 then length(x)::integer end as chars from e""",
)
def articles(spark, sf):
    p = frames.table(spark, sf, "pages").select("page_id", readers.article_text(F.col("html"), 200).alias("text"))
    return p.select("page_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


@query("src13_text_corpus", r"select doc_id, length(t)::bigint as chars from (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents) where length(t) > 500")
def corpus(spark, sf):
    return readers.long_enough(frames.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.length("text").cast("long").alias("chars"))


@query("src10_shortest_name", "select code, name from (select n_regionkey as code, n_name as name, row_number() over (partition by n_regionkey order by length(n_name), n_name) as k from nation) where k = 1")
def shortest(spark, sf):
    n = frames.table(spark, sf, "nation")
    return n.groupBy(F.col("n_regionkey").alias("code")).agg(F.min_by("n_name", F.struct(F.length("n_name"), "n_name")).alias("name"))


@query("src08_chart_rows", "select epoch(date_trunc('second', ts))::bigint as at, round(value, 6) as open, round(value + 1, 6) as high, round(value - 1, 6) as low, round(value, 6) as close from events where event_id % 7 <> 0 and value is not null")
def chart_rows(spark, sf):
    """A columnar answer for each symbol and day, parsed; rows with a missing price go."""
    e = frames.ticks(spark, sf).select("symbol", F.to_date("ts").alias("day"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "id", F.when(F.col("id") % 7 != 0, F.col("price")).alias("p"))
    x = F.sort_array(F.collect_list(F.struct("t", "id", "p")))
    days = e.groupBy("symbol", "day").agg(x.alias("x"))
    part = lambda f: F.transform("x", f)
    quote = F.array(F.struct(part(lambda v: v["p"]).alias("open"), part(lambda v: v["p"] + 1).alias("high"), part(lambda v: v["p"] - 1).alias("low"), part(lambda v: v["p"]).alias("close")))
    result = F.array(F.struct(part(lambda v: v["t"]).alias("timestamp"), F.struct(quote.alias("quote")).alias("indicators")))
    payload = days.select(F.to_json(F.struct(F.struct(result.alias("result")).alias("chart"))).alias("json"))
    return rounded(readers.chart_rows(payload).select(F.unix_timestamp("ts").alias("at"), "open", "high", "low", "close"))


@query("src14_live_quotes", """with q as (select p_partkey as k, floor(p_retailprice)::bigint as big, lpad((p_partkey % 100)::varchar, 2, '0')::integer as pips from part where p_partkey % 5 <> 0 and p_partkey % 7 <> 0)
  select 'P' || k as pair, k * 1000 as at, round(big + pips / 100::double, 6) as bid, round(big + 1 + pips / 100::double, 6) as ask, round(big + 0.5 + pips / 100::double, 6) as mid from q""")
def live_quotes(spark, sf):
    """Quotes of nine fields; a line without a field, or with a broken one, goes."""
    p = frames.table(spark, sf, "part")
    big, key = F.floor("p_retailprice"), F.col("p_partkey")
    pips = F.when(key % 7 == 0, F.lit("x1")).otherwise(F.lpad((key % 100).cast("string"), 2, "0"))
    fields = [F.concat(F.lit("P"), key.cast("string")), (key * 1000 * 1000).cast("string"), F.concat(big.cast("string"), F.lit(".")), pips, F.concat((big + 1).cast("string"), F.lit(".")), pips, F.lit("0"), F.lit("0")]
    line = F.concat(F.concat_ws(",", *fields), F.when(key % 5 == 0, F.lit("")).otherwise(F.lit(",0")))
    return rounded(readers.live_quotes(p.select(line.alias("value"))).select("pair", F.unix_timestamp("ts").alias("at"), "bid", "ask", "mid"))
