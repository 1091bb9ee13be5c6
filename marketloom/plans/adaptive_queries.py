"""Adaptive intervals and tails, calibration, permutation tests, stopping policies and finer measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import recursive, special
from marketloom.operators import bars, forecast, research, scoring
from marketloom.operators import indicators as ind
from marketloom.plans import series_sql as ssql
from marketloom.plans.catalog import query, rounded
from marketloom.plans.forecast_queries import EDGE, LABEL, LV, S, log_variance, spillover, student_probabilities, targets
from marketloom.plans.relational_queries import BINS, RETURNS, binned, returns
from marketloom.plans.research_queries import optimal_stopping
from marketloom.plans.score_queries import VOL, vol_forecast
from marketloom.sources import frames

TRAIN = "day < date '1999-10-13'"


def train():
    return F.col("day") < F.lit("1999-10-13").cast("date")


# Finer measures.

MEASURES = ("rv", "rq", "bpv", "rsp", "rsn")


def _measures(name: str, source: str) -> str:
    return f"""{name}r as (select symbol, ts::date as day, ts, case when close > 0 and lag(close) over w > 0 then ln(close) - ln(lag(close) over w) end as r from {source} window w as (partition by symbol, ts::date order by ts)),
      {name}s as (select *, lag(r) over (partition by symbol, day order by ts) as r1 from {name}r),
      {name} as (select symbol, day, sum(r * r) as rv, count(r) / 3 * sum(r * r * r * r) as rq, pi() / 2 * sum(abs(r) * abs(r1)) as bpv, sum(case when r > 0 then r * r when r is not null then 0 end) as rsp, sum(case when r < 0 then r * r when r is not null then 0 end) as rsn, count(r) as n from {name}s group by 1, 2 having count(r) > 0)"""


_RATIO = ", ".join(f"case when count(case when c.{m} > 1e-12 then f.{m} end) >= 10 then quantile_cont(case when c.{m} > 1e-12 then f.{m} / c.{m} end, 0.5) else 1 end as k_{m}" for m in ("rv", "rq", "bpv"))
_SHARE = "coalesce(least(greatest(c.rsp / greatest(c.rsp + c.rsn, 1e-12), 0.05), 0.95), 0.5)"


@query(
    "rsm12_hourly_to_five_minute",
    f"""with {frames.HOURLY}, fives as (select symbol, time_bucket(interval 5 minute, ts) as ts, arg_max(price, (ts, id)) as close from ticks where ts >= timestamp '2024-01-16' group by symbol, time_bucket(interval 5 minute, ts)),
    {_measures('hm', 'hourly')}, {_measures('fm', 'fives')}, k as (select symbol, {_RATIO} from hm c join fm f using (symbol, day) where c.rv > 1e-12 group by 1)
    select c.symbol, c.day, round(coalesce(f.rv, c.rv * coalesce(k_rv, 1)), 6) as rv, round(coalesce(f.rq, c.rq * coalesce(k_rq, 1)), 6) as rq, round(coalesce(f.bpv, c.bpv * coalesce(k_bpv, 1)), 6) as bpv, round(coalesce(f.rsp, coalesce(f.rv, c.rv * coalesce(k_rv, 1)) * {_SHARE}), 6) as rsp,
      round(coalesce(f.rsn, coalesce(f.rv, c.rv * coalesce(k_rv, 1)) * (1 - {_SHARE})), 6) as rsn, coalesce(f.n, c.n * 12)::bigint as n, (f.rv is null) as estimated from hm c left join fm f on f.symbol = c.symbol and f.day = c.day left join k on k.symbol = c.symbol""",
)
def hourly_to_five_minute(spark, sf):
    """Five-minute measures where there are five-minute bars, else scaled hourly ones."""
    t = frames.ticks(spark, sf).where("ts >= timestamp_ntz '2024-01-16 00:00:00'")
    fine = bars.realized(bars.resample(t, bars.bucket("ts", "5 minutes").alias("ts"), "price", F.struct("ts", "id")))
    return rounded(bars.scale_to_finer(bars.realized(frames.hourly(spark, sf)), fine, per=12, least=10))


# Tails that adapt.


@query(
    "var12_scaled_tails",
    ssql.recursive(
        RETURNS + f""", x as (select symbol, day, r as z, row_number() over (partition by symbol order by day) as i, {TRAIN} as train from ret where r is not null), s as (select symbol, stddev_pop(z) as sd, var_pop(z) as v, quantile_cont(z, 0.05) as q, max(i) as last from x where train group by 1),
        y as (select x.symbol, z, i - last + 1 as k, sd, s.v as v0, q from x join s using (symbol) where i >= last),
        {ssql.along('m', 'y', {'v': '0.94 * p.v + 0.06 * case when p.k = 1 then 0 else p.z * p.z end + case when p.k = 1 then 0.06 * p.z * p.z else 0 end', 'z': 't.z'}, {'v': 't.v0', 'z': 't.z'})}
        select y.symbol, count(*) as n, round(avg((y.z <= q)::integer), 6) as fixed_rate, round(avg((y.z <= q / (sd + 1e-12) * sqrt(greatest(v, 1e-12)))::integer), 6) as scaled_rate, round(avg(q / (sd + 1e-12) * sqrt(greatest(v, 1e-12))), 6) as mean_level from y join m using (symbol, k) where k > 1 group by 1"""
    ),
)
def scaled_tails(spark, sf):
    """A quantile's shape frozen in training, times a deviation that is smoothed exponentially."""

    def f(z, seen):
        last = int(seen.sum()) - 1
        path = np.full(len(z), np.nan)
        held = z[: last + 1]
        v = held.var()
        for t in range(last + 1, len(z)):
            v = 0.94 * v + 0.06 * z[t - 1] ** 2
            path[t] = np.quantile(held, 0.05) / (held.std() + 1e-12) * np.sqrt(max(v, 1e-12))
        fixed = np.where(np.isnan(path), np.nan, np.quantile(held, 0.05))
        return {"z": z, "fixed": fixed, "scaled": path}

    rows = returns(spark, sf).where("r is not null").withColumn("seen", train().cast("double"))
    out = ind.per_symbol(rows, ["r", "seen"], dict.fromkeys(("z", "fixed", "scaled"), "double"), f).where("scaled is not null")
    rate = lambda c: F.avg((F.col("z") <= F.col(c)).cast("double"))
    return rounded(out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rate("fixed").alias("fixed_rate"), rate("scaled").alias("scaled_rate"), F.avg("scaled").alias("mean_level")))


@query(
    "var12_weighted_quantile",
    RETURNS + """, a as (select symbol, abs(r) as z, exp(-(row_number() over (partition by symbol order by day desc) - 1) / 250::double) as w, day from ret where r is not null), c as (select symbol, z, sum(w) over (partition by symbol order by z, day) / sum(w) over (partition by symbol) as upto from a)
    select symbol, round(coalesce(min(z) filter (upto >= 0.95), max(z)), 6) as q95, round(quantile_cont(z, 0.95), 6) as plain from c group by 1""",
)
def weighted_quantile(spark, sf):
    """The least size at which the weights, which fade with age, reach the level."""
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("day").desc())) - 1
    a = returns(spark, sf).where("r is not null").select("symbol", "day", F.abs("r").alias("z"), F.exp(-age / 250.0).alias("w"))
    return rounded(scoring.weighted_quantile(a, "z", "w", 0.95, "symbol", "day"))


@query("var12_drift_tails")
def drift_tails(spark, sf):
    """Quantiles estimated anew from the last drift of the size on, against those of training."""

    def f(z, seen):
        last = int(seen.sum())
        found = [t for t in recursive.drifts(np.abs(z)) if t > last]
        fixed, path = np.full(len(z), np.nan), np.full(len(z), np.nan)
        for t in range(last, len(z)):
            known = [d for d in found if d <= t]
            own = z[known[-1] : t] if known else z[:0]
            fixed[t] = np.quantile(z[:last], 0.05)
            path[t] = np.quantile(own, 0.05) if len(own) >= 60 else fixed[t]
        return {"z": z, "fixed": fixed, "reset": path, "drift": np.isin(np.arange(len(z)), found).astype(float)}

    rows = returns(spark, sf).where("r is not null").withColumn("seen", train().cast("double"))
    out = ind.per_symbol(rows, ["r", "seen"], dict.fromkeys(("z", "fixed", "reset", "drift"), "double"), f).where("reset is not null")
    rate = lambda c: F.avg((F.col("z") <= F.col(c)).cast("double"))
    return rounded(out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rate("fixed").alias("fixed_rate"), rate("reset").alias("reset_rate"), F.sum("drift").cast("long").alias("drifts")))


@query("var12_breakpoints")
def breakpoints(spark, sf):
    """Where the level of the 60-row deviation breaks: least squares with a penalty for each break."""
    o = ind.over(60)
    rows = returns(spark, sf).where("r is not null").withColumn("x", F.when(F.count("r").over(o) == 60, F.stddev_samp("r").over(o))).where("x is not null")

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        x, days = pdf["x"].to_numpy(), pdf["day"].to_numpy()
        cuts = [0, *recursive.breaks(x, 2 * np.log(len(x)) * x.var()), len(x)]
        made = [(pdf["symbol"].iloc[0], days[b], float(x[a:b].mean()), float(x[b:c].mean())) for a, b, c in zip(cuts, cuts[1:], cuts[2:], strict=False)]
        return pd.DataFrame(made, columns=["symbol", "day", "before", "after"])

    return rounded(rows.select("symbol", "day", "x").groupBy("symbol").applyInPandas(f, "symbol string, day date, before double, after double"))


# Intervals by stratum, with a level each that follows its misses.


def _strata_sql(two_way: bool) -> str:
    cell = "vol * 2 + dd" if two_way else "vol * 2"
    pick = "case when len(own) >= 60 then own when len(near) >= 60 then near else every end"
    # A level asks for a place among the sizes seen before; the row's stratum moves its own level.
    half = "t.held[greatest(least(ceil((len(t.held) + 1) * (1 - {a}[t.cell + 1])), len(t.held)), 1)::integer]"
    miss = f"(t.z > {half.format(a='a')})::integer"
    step = "list_transform(p.a, lambda v, i: case when i = p.cell + 1 then v + 0.01 * (0.1 - p.miss) else v end)"
    row = f"select symbol, k, cell, held, z, a, {miss} as miss, {half.format(a='a')} as half from"
    return ssql.recursive(
        S + f""", edges as (select symbol, quantile_cont(sigma, 0.5) as edge from s where {TRAIN} and r is not null group by 1),
        sized as (select s.symbol, day, abs(r / sigma) as z, (sigma >= edge)::integer as vol, row_number() over (partition by s.symbol order by day) as i, {TRAIN} as train, sum(r) over (partition by s.symbol order by day) as cum from s join edges using (symbol) where r is not null and sigma is not null),
        topped as (select *, max(cum) over (partition by symbol order by day) as top from sized), below as (select *, coalesce(lag(cum < top) over (partition by symbol order by day), false)::integer as dd from topped),
        celled as (select *, {cell} as cell from below), held_ as (select *, list({{'z': z, 'v': vol, 'c': cell}}) over (partition by symbol order by day rows between 750 preceding and 1 preceding) as seen, max(case when train then i end) over (partition by symbol) as last from celled),
        pools as (select symbol, i - last as k, z, cell, list_sort(list_transform(list_filter(seen, lambda x: x.c = cell), lambda x: x.z)) as own, list_sort(list_transform(list_filter(seen, lambda x: x.v = vol), lambda x: x.z)) as near, list_sort(list_transform(seen, lambda x: x.z)) as every from held_ where i > last),
        rows_ as (select symbol, k, z, cell, {pick} as held from pools),
        steps as ({row} (select *, [0.1::double, 0.1, 0.1, 0.1] as a from rows_ where k = 1) t union all {row} (select n.*, {step} as a from steps p join rows_ n on n.symbol = p.symbol and n.k = p.k + 1) t)
        select symbol, cell::integer as cell, count(*) as n, round(1 - avg(miss), 6) as coverage, round(avg(half), 6) as mean_half_width from steps group by 1, 2"""
    )


def _strata(spark, sf, two_way: bool):
    rows = targets(spark, sf).where("r is not null and sigma is not null").select("symbol", "day", "r", "sigma")
    edge = rows.where(train()).groupBy("symbol").agg(F.percentile("sigma", F.lit(0.5)).alias("edge"))
    rows = rows.join(F.broadcast(edge), "symbol")  # a row per symbol
    rows = rows.withColumn("cum", F.sum("r").over(ind.w())).withColumn("below", (F.col("cum") < F.max("cum").over(ind.w())).cast("int"))
    rows = rows.withColumns({"vol": (F.col("sigma") >= F.col("edge")).cast("int"), "dd": F.coalesce(F.lag("below").over(ind.w()), F.lit(0)) if two_way else F.lit(0), "z": F.abs(F.col("r") / F.col("sigma")), "seen": train().cast("int")})

    def f(z, vol, dd, seen):
        half, cell = recursive.stratum_widths(z, vol.astype(int), vol.astype(int) * 2 + dd.astype(int), int(seen.sum()))
        return {"cell": cell, "half": half, "miss": np.where(np.isnan(half), np.nan, z > half)}

    out = ind.per_symbol(rows, ["z", "vol", "dd", "seen"], {"cell": "int", "half": "double", "miss": "double"}, f).where("half is not null")
    return rounded(out.groupBy("symbol", "cell").agg(F.count(F.lit(1)).alias("n"), (1 - F.avg("miss")).alias("coverage"), F.avg("half").alias("mean_half_width")))


@query("cnf06_stratified_intervals", _strata_sql(False))
def stratified_intervals(spark, sf):
    return _strata(spark, sf, False)


@query("cnf06_two_way_intervals", _strata_sql(True))
def two_way_intervals(spark, sf):
    """Strata by deviation and by whether the account is below its top."""
    return _strata(spark, sf, True)


# Calibration of class probabilities.

GRID = [round(0.2 + 0.1 * i, 1) for i in range(49)]
PROBS = S + f", pr as (select symbol, day, regime::integer as regime, {TRAIN} as train, {LABEL} as y, {ssql.t6_cdf('-' + EDGE)} as p0, {ssql.t6_cdf(EDGE)} - {ssql.t6_cdf('-' + EDGE)} as p1, 1 - {ssql.t6_cdf(EDGE)} as p2 from d where band is not null and sigma is not null and rh is not null)"


def _heated(c: str, t: str) -> str:
    return f"greatest({c}, 1e-9) ** (1 / {t})"


def labelled(spark, sf):
    y = forecast.label(F.col("rh"), F.col("band") * F.sqrt(F.lit(5.0)))
    return student_probabilities(targets(spark, sf).where("band is not null and sigma is not null and rh is not null")).select("symbol", "day", "regime", train().alias("train"), y.alias("y"), "p0", "p1", "p2")


@query(
    "p311_temperature",
    PROBS + f""", heated as (select symbol, train, t, {_heated("case y when 0 then p0 when 1 then p1 else p2 end", "t")} / ({' + '.join(_heated(f'p{k}', 't') for k in range(3))}) as p from pr, (select unnest([{', '.join(f'{t}::double' for t in GRID)}]) as t)),
    l as (select symbol, train, t, avg(-ln(greatest(p, 1e-12))) as l from heated group by 1, 2, 3), f as (select symbol, arg_min(t, (round(l, 9), t)) as t from l where train group by 1)
    select f.symbol, f.t as temperature, round(a.l, 6) as before, round(b.l, 6) as after from f join l a on a.symbol = f.symbol and a.t = 1 and not a.train join l b on b.symbol = f.symbol and b.t = f.t and not b.train""",
)
def temperature(spark, sf):
    """The temperature with the least log score in training, and the score after it, by symbol."""
    rows = labelled(spark, sf)
    hot = lambda c, t: F.pow(F.greatest(c, F.lit(1e-9)), F.lit(1 / t))
    probs = [F.col(f"p{k}") for k in range(3)]
    loss = lambda t: -F.ln(F.greatest(hot(scoring.picked(F.col("y"), probs), t) / sum((hot(p, t) for p in probs[1:]), hot(probs[0], t)), F.lit(1e-12)))
    means = F.array(*[F.avg(F.when(F.col("train"), loss(t))) for t in GRID]), F.array(*[F.avg(F.when(~F.col("train"), loss(t))) for t in GRID])
    g = rows.groupBy("symbol").agg(means[0].alias("own"), means[1].alias("later"))
    g = g.withColumn("own", F.transform("own", lambda x: F.round(x, 9))).withColumn("at", F.array_position("own", F.array_min("own")).cast("int"))
    grid = F.array(*map(F.lit, GRID))
    return rounded(g.select("symbol", F.element_at(grid, F.col("at")).alias("temperature"), F.element_at("later", GRID.index(1.0) + 1).alias("before"), F.element_at("later", F.col("at")).alias("after")))


@query(
    "p312_regime_switch",
    PROBS + """, rates as (select symbol, avg((y = 0)::integer) as c0, avg((y = 1)::integer) as c1, avg((y = 2)::integer) as c2 from pr where train group by 1),
    l as (select symbol, regime, -ln(greatest(case y when 0 then p0 when 1 then p1 else p2 end, 1e-12)) as one, -ln(greatest(case y when 0 then c0 when 1 then c1 else c2 end, 1e-12)) as other from pr join rates using (symbol) where not train)
    select symbol, regime, count(*) as n, round(avg(one), 6) as one_model, round(avg(case when regime = 1 then other else one end), 6) as switched from l group by 1, 2""",
)
def regime_switch(spark, sf):
    """The middle regime takes class rates of training instead of the model: log scores by regime."""
    rows = labelled(spark, sf)
    c = rows.where("train").groupBy("symbol").agg(*[F.avg((F.col("y") == k).cast("double")).alias(f"c{k}") for k in range(3)])
    rows = rows.where("not train").join(F.broadcast(c), "symbol")  # a row per symbol
    score = lambda n: scoring.log_score(scoring.picked(F.col("y"), [F.col(f"{n}{k}") for k in range(3)]))
    return rounded(rows.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg(score("p")).alias("one_model"), F.avg(F.when(F.col("regime") == 1, score("c")).otherwise(score("p"))).alias("switched")))


# Regressions.


@query("har06_residual_sums", f"{LV}, {ssql.past_fit('e', 'h', ssql.HARX, 'y')} select symbol, day, n, round(case when n >= 30 then yy - ss end, 3) as ssr from e_s")
def residual_sums(spark, sf):
    """Sum of squared residuals of each expanding fit, from its Gram matrix."""
    rows = forecast.expanding_ols(log_variance(spark, sf), ssql.HARX, "y", least=30, residuals=True)
    return rounded(rows.select("symbol", "day", F.col("n_fit").alias("n"), "ssr"), 3)


@query("har22_weighted_spillover", ssql.weighted_spillover(LV))
def weighted_spillover(spark, sf):
    """Others' log variance, standardised by its own past and weighted by what each passes on."""
    v = log_variance(spark, sf)
    past = ind.w().rowsBetween(Window.unboundedPreceding, -1)
    z = F.when(F.count("lv").over(past) >= 60, (F.col("lv") - F.avg("lv").over(past)) / F.greatest(F.stddev_samp("lv").over(past), F.lit(1e-12)))
    z = v.select(F.col("symbol").alias("from"), "day", F.year("day").alias("year"), z.alias("z")).where("z is not null")
    share = spillover(spark, sf).where("to <> from")
    share = share.withColumn("share", F.col("share") / F.greatest(F.sum("share").over(Window.partitionBy("year", "to")), F.lit(1e-12)))
    rows = z.join(F.broadcast(share), ["year", "from"])  # a row per year and pair of symbols
    return rounded(rows.groupBy(F.col("to").alias("symbol"), "day").agg(F.sum(F.col("share") * F.col("z")).alias("weighted")), 5)


# Permutations.

DRAWS, RUN = 100, 20
PERMUTED = BINS + f""", x as (select symbol, row_number() over (partition by symbol order by day) - 1 as place, isodow(day)::integer as dow, (bin = 2)::integer as y from b where bin is not null),
  d as (select symbol, draw, place, y, md5(symbol || '|' || draw || '|' || (place // {RUN})) as h from x, (select unnest(range(1, {DRAWS + 1})) as draw)),
  s as (select symbol, draw, y, row_number() over (partition by symbol, draw order by h, place) - 1 as place from d), base as (select avg(y) as p from x),
  nb as (select draw, dow, (sum(s.y) - count(*) * p) / sqrt(count(*) * p * (1 - p)) as z from s join x using (symbol, place), base group by draw, dow, p),
  ob as (select dow, count(*) as n, (sum(y) - count(*) * p) / sqrt(count(*) * p * (1 - p)) as z from x, base group by dow, p)"""


def permuted(spark, sf):
    """(observed, null): z of a rise by weekday, and over permutations of runs of rows."""
    b = binned(spark, sf).where("bin is not null")
    x = b.select("symbol", (F.row_number().over(ind.w()) - 1).alias("place"), (F.weekday("day") + 1).alias("dow"), (F.col("bin") == 2).cast("int").alias("y"))
    shuffled = scoring.permuted_runs(x.select("symbol", "place", "y"), "y", RUN, DRAWS)
    base = F.broadcast(x.agg(F.avg("y").alias("p")))  # one row
    n, p = F.count(F.lit(1)), F.first("p")
    z = ((F.sum("y") - n * p) / F.sqrt(n * p * (1 - p))).alias("z")
    null = shuffled.join(x.select("symbol", "place", "dow"), ["symbol", "place"]).crossJoin(base).groupBy("draw", "dow").agg(z)
    return x.crossJoin(base).groupBy("dow").agg(n.alias("n"), z), null


@query("inf05_block_permutation", PERMUTED + " select dow, count(*) as draws, round(avg(z), 5) as mean, round(stddev_samp(z), 5) as sd, round(max(abs(z)), 5) as most from nb group by 1")
def block_permutation(spark, sf):
    _, null = permuted(spark, sf)
    return rounded(null.groupBy("dow").agg(F.count(F.lit(1)).alias("draws"), F.avg("z").alias("mean"), F.stddev_samp("z").alias("sd"), F.max(F.abs("z")).alias("most")), 5)


@query(
    "inf07_calibrated_p",
    PERMUTED + f""", l as (select dow, sqrt(greatest(avg(z * z), 1e-12)) as inflation from nb group by 1), k as (select o.dow, n, o.z, inflation, (1 + count(*) filter (nb.z >= o.z)) / ({DRAWS} + 1)::double as p_count, abs(o.z) / inflation as a from ob o join l using (dow) join nb using (dow) group by o.dow, n, o.z, inflation)
    select dow, n, round(z, 5) as z, round(inflation, 5) as inflation, round(p_count, 6) as p_count, round(2 * (1 - {ssql.normal_cdf('a')}), 5) as p_tail from k""",
)
def calibrated_p(spark, sf):
    """p by counting, and by a normal tail widened by the null's inflation."""
    observed, null = permuted(spark, sf)
    both = observed.join(null.withColumnRenamed("z", "z0"), "dow")
    g = both.groupBy("dow").agg(F.first("n").alias("n"), F.first("z").alias("z"), F.sqrt(F.greatest(F.avg(F.col("z0") * F.col("z0")), F.lit(1e-12))).alias("inflation"), ((1 + F.count_if(F.col("z0") >= F.col("z"))) / (F.count(F.lit(1)) + 1)).alias("p_count"))

    @F.pandas_udf("double")
    def tail(a: pd.Series) -> pd.Series:
        return pd.Series(2 * (1 - special.normal_cdf(a.to_numpy())))

    return rounded(g.withColumn("p_tail", tail(F.abs("z") / F.col("inflation"))), 5, p_count=6)


# Scores by simulation.

PATHS = 64


@query(
    "scr05_monte_carlo_crps",
    VOL + f""", m as (select symbol, r, sqrt(h) as s, list_transform(range(1, {PATHS + 1}), lambda j: md5(symbol || '|' || day || '|' || j)) as a, list_transform(range(1, {PATHS + 1}), lambda j: md5(day || '|' || symbol || '|' || j)) as b from vv),
    u as (select symbol, r, s, list_transform(a, lambda x: [(('0x' || x[1:13])::bigint + 0.5) / 4503599627370496.0::double, (('0x' || x[14:26])::bigint + 0.5) / 4503599627370496.0::double]) as a, list_transform(b, lambda x: [(('0x' || x[1:13])::bigint + 0.5) / 4503599627370496.0::double, (('0x' || x[14:26])::bigint + 0.5) / 4503599627370496.0::double]) as b from m),
    x as (select symbol, r, list_transform(range(1, {PATHS + 1}), lambda j: s * sqrt(-2 * ln(a[j][1])) * cos(2 * pi() * a[j][2]) / sqrt(-2 * (ln(b[j][1]) + ln(b[j][2])) / 4)) as x from u)
    select symbol, round(avg(list_avg(list_transform(x, lambda v: abs(v - r))) - 0.5 * list_avg(list_transform(range(1, {PATHS // 2 + 1}), lambda j: abs(x[j] - x[j + {PATHS // 2}])))), 6) as crps, count(*) as n from x group by 1""",
)
def monte_carlo_crps(spark, sf):
    """CRPS of a scaled Student t with 4 degrees of freedom from draws that depend on the row alone."""
    rows = vol_forecast(spark, sf)
    return rounded(rows.groupBy("symbol").agg(F.avg(scoring.crps_student4(F.col("r"), F.sqrt("h"), ["symbol", "day"], PATHS)).alias("crps"), F.count(F.lit(1)).alias("n")))


# Stopping policies.

STOPS = ssql.optimal_stopping(RETURNS)


@query(
    "dec04_policies",
    STOPS.replace(" select symbol, left_::integer as days_left", ", st as (select symbol, left_::integer as days_left", 1)
    + """), lim as (select symbol, list(coalesce(stop_at, 'inf'::double) order by days_left) as stops from st group by 1), pa as (select symbol, list(r) over (partition by symbol order by day rows between 1 following and 10 following) as x from ret where r is not null),
    cu as (select symbol, stops, list_transform(range(0, 11), lambda i: case when i = 0 then 0 else list_sum(x[1:i]) end) as c from pa join lim using (symbol) where len(x) = 10),
    ex as (select *, coalesce(list_filter(range(0, 10), lambda h: c[h + 1] >= stops[10 - h])[1], 10) as h from cu)
    select symbol, count(*) as n, round(avg(least(c[h + 1], 1.5) - 0.002 * h), 6) as optimal, round(avg(h), 6) as mean_days, round(avg(least(c[11], 1.5) - 0.02), 6) as hold, round(avg(least(c[6], 1.5) - 0.01), 6) as five_days from ex group by 1""",
)
def policies(spark, sf):
    """Mean results of stopping by the induction's levels, of holding ten days and of closing after five."""
    stops = optimal_stopping(spark, sf).groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("days_left", F.coalesce("stop_at", F.lit(float("inf"))).alias("at")))), lambda s: s["at"]).alias("stops"))
    rows = returns(spark, sf).where("r is not null").withColumn("x", F.collect_list("r").over(ind.w().rowsBetween(1, 10))).where(F.size("x") == 10)
    return rounded(research.stopping_results(rows.join(F.broadcast(stops), "symbol"), "x", "stops", most=1.5, cost=0.002))  # a row per symbol
