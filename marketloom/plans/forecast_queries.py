"""Volatility forecasts and three-class forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import hashed, recursive
from marketloom.operators import bars, forecast, panel
from marketloom.operators import indicators as ind
from marketloom.plans import series_sql as ssql
from marketloom.plans.bar_queries import RET, RET2
from marketloom.plans.catalog import query, rounded
from marketloom.plans.relational_queries import BINS, RETURNS, binned, returns
from marketloom.plans.score_queries import PB, binary
from marketloom.sources import frames

LV = f"""with {frames.DAILY}, v as (select symbol, day, ln(greatest((ln(high) - ln(low)) ** 2 / (4 * ln(2)), 1e-4)) as lv, (ln(high) - ln(low)) ** 2 / (4 * ln(2)) as rv from daily),
  h as (select symbol, day, rv, lv, case when count(lv) over a = 5 then avg(lv) over a end as lw, case when count(lv) over m = 22 then avg(lv) over m end as lm, lead(lv) over (partition by symbol order by day) as y from v
    window a as (partition by symbol order by day rows between 4 preceding and current row), m as (partition by symbol order by day rows between 21 preceding and current row))"""


def log_variance(spark, sf):
    """Daily log Parkinson variance with its week and month means and the next day's."""
    e = bars.estimators(frames.daily(spark, sf)).select("symbol", "day", F.col("parkinson").alias("rv"))
    full = lambda n: ind.full(F.avg, "lv", n)
    e = e.withColumn("lv", F.ln(F.greatest("rv", F.lit(1e-4))))
    return e.withColumns({"lw": full(5), "lm": full(22), "y": F.lead("lv").over(ind.w())})


@query("har04_design", LV + " select symbol, day, round(lv, 6) as lv, round(lw, 6) as lw, round(lm, 6) as lm, round(y, 6) as y from h")
def design(spark, sf):
    return rounded(log_variance(spark, sf).select("symbol", "day", "lv", "lw", "lm", "y"))


@query("har04_full_design", ssql.full_design(RET2))
def full_design(spark, sf):
    return rounded(forecast.har_design(bars.realized(frames.hourly(spark, sf)), month=10, z_window=10).select("symbol", "day", "n", "rv", "rq", "bpv", "rsp", "rsn", "lv", "lq", "lp", "ln", "lw", "lm", "regime", "y", "lqv"))


@query("har02_calendar_features", f"with {frames.DAILY} select symbol, day, (isodow(day) = 1)::integer as monday, (row_number() over (partition by symbol, date_trunc('month', day) order by day desc) <= 2)::integer as month_end, (isodow(day) = 5 and day(day) <= 7)::integer as payrolls from daily")
def calendar_features(spark, sf):
    k = F.row_number().over(Window.partitionBy("symbol", F.trunc("day", "month")).orderBy(F.col("day").desc()))
    d = F.dayofweek("day")
    return frames.daily(spark, sf).select("symbol", "day", (d == 2).cast("int").alias("monday"), (k <= 2).cast("int").alias("month_end"), ((d == 6) & (F.dayofmonth("day") <= 7)).cast("int").alias("payrolls"))


@query("har03_weekday_seasonality", LV + ", m as (select symbol, isodow(day)::integer as dow, quantile_cont(lv, 0.5) as m from v where day < date '1999-10-13' group by 1, 2) select symbol, dow, round(m - avg(m) over (partition by symbol), 6) as factor from m")
def weekday(spark, sf):
    v = log_variance(spark, sf).where(F.col("day") < F.lit("1999-10-13").cast("date"))
    dow = F.when(F.dayofweek("day") == 1, 7).otherwise(F.dayofweek("day") - 1)
    m = v.groupBy("symbol", dow.alias("dow")).agg(F.percentile("lv", F.lit(0.5)).alias("m"))
    return rounded(m.select("symbol", "dow", (F.col("m") - F.avg("m").over(Window.partitionBy("symbol"))).alias("factor")))


@query("har05_09_expanding_simple", LV + " select symbol, day, round(case when n >= 30 then b end, 5) as slope, round(case when n >= 30 then a end, 5) as intercept from (select symbol, day, count(case when lw is not null and y is not null then 1 end) over w as n, regr_slope(y, lw) over w as b, regr_intercept(y, lw) over w as a from h window w as (partition by symbol order by day rows between unbounded preceding and 1 preceding))")
def expanding_simple(spark, sf):
    return rounded(forecast.simple_ols(log_variance(spark, sf), "lw", "y").select("symbol", "day", "slope", "intercept"), 5)


@query("har05_06_expanding_har", ssql.expanding_har(LV) + " select symbol, day, " + ", ".join(f"round({c}, 5) as {c}" for c in ("y", "expanding", "rolling", "shrunk", "combined")) + " from f")
def expanding_har(spark, sf):
    """Forecasts of the day, week and month model, expanding and rolling, with panel shrinkage."""
    return rounded(har_forecasts(spark, sf), 5)


def har_forecasts(spark, sf):
    x = ["lv", "lw", "lm"]
    rows = forecast.predict(forecast.expanding_ols(log_variance(spark, sf), x, "y"), x, "expanding")
    rows = forecast.predict(forecast.expanding_ols(rows.drop("beta"), x, "y", window=500), x, "rolling")
    rows = forecast.predict(forecast.shrink_to_panel(rows, 0.5, 4), x, "shrunk")
    return rows.select("symbol", "day", "y", "expanding", "rolling", "shrunk", forecast.geometric_mean(["expanding", "rolling", "shrunk"]).alias("combined"))


HAR_LOSS = ", ".join(f"round(avg(exp(y - {c}) - (y - {c}) - 1), 5) as {n}" for c, n in (("expanding", "expanding"), ("rolling", "rolling"), ("shrunk", "shrunk"), ("ln(combined)", "combined")))


@query("har16_combination_loss", ssql.expanding_har(LV) + f" select symbol, {HAR_LOSS} from f where y is not null and combined is not null group by 1")
def combination(spark, sf):
    f = har_forecasts(spark, sf).where("y is not null and combined is not null")
    loss = lambda c: F.avg(F.exp(F.col("y") - c) - (F.col("y") - c) - 1)
    return rounded(f.groupBy("symbol").agg(*[loss(F.col(c)).alias(c) for c in ("expanding", "rolling", "shrunk")], loss(F.ln("combined")).alias("combined")), 5)


@query("har12_moving_average", f"with {frames.DAILY}, g as (select symbol, day, 0.5 * (ln(high) - ln(low)) ** 2 - (2 * ln(2) - 1) * (ln(close) - ln(open)) ** 2 as gk from daily) select symbol, day, round(case when count(gk) over w = 20 then sqrt(greatest(avg(gk) over w, 0)) end, 6) as sigma from g window w as (partition by symbol order by day rows between 20 preceding and 1 preceding)")
def moving_average(spark, sf):
    g = bars.estimators(frames.daily(spark, sf))
    o = ind.w().rowsBetween(-20, -1)
    return rounded(g.select("symbol", "day", F.when(F.count("gk").over(o) == 20, F.sqrt(F.greatest(F.avg("gk").over(o), F.lit(0.0)))).alias("sigma")))


@query("har13_jump_model", ssql.jump_model(RET2))
def jump_model(spark, sf):
    r = bars.realized(frames.hourly(spark, sf)).withColumns({"lv": F.ln(F.greatest("rv", F.lit(1e-12))), "jump": F.ln(1 + F.greatest(F.col("rv") - F.col("bpv"), F.lit(0.0)))})
    r = r.withColumns({"lw": ind.full(F.avg, "lv", 5), "y": F.lead("lv").over(ind.w())})
    x = ["lv", "lw", "jump"]
    return rounded(forecast.predict(forecast.expanding_ols(r, x, "y", least=9), x, "forecast").select("symbol", "day", "y", "forecast"), 6, forecast=4)


@query("har15_seasonal_ewma", ssql.seasonal_ewma(RET))
def seasonal_ewma(spark, sf):
    s = bars.seasonality(frames.hourly(spark, sf), F.hour("ts")).select("symbol", F.col("slot").alias("hour"), "factor")
    h = frames.hourly(spark, sf).withColumn("hour", F.hour("ts")).withColumn("r", bars.log_return("close", ind.w("ts"))).where("r is not null")
    h = h.join(F.broadcast(s), ["symbol", "hour"]).withColumn("x", F.pow(F.col("r") / F.greatest("factor", F.lit(1e-6)), F.lit(2)))  # 24 rows per symbol
    e = ind.per_symbol(h, ["x"], {"v": "double"}, lambda x: {"v": recursive.ewm(x, 0.06)}, "ts")
    return rounded(e.join(h.select("symbol", "ts", "factor"), ["symbol", "ts"]).select("symbol", "ts", (F.sqrt("v") * F.col("factor")).alias("sigma")), 5)


@query("har17_weighted_models", ssql.weighted_models(RETURNS))
def weighted(spark, sf):
    """Online weights of three variance forecasts by their QLIKE."""

    def f(p, a, b, c):
        x, wt, out = np.stack([a, b, c], 1), np.ones(3) / 3, np.empty(len(p))
        for t in range(len(p)):
            out[t] = wt @ x[t]
            loss = np.log(x[t]) + p[t] / x[t]
            wt = wt * np.exp(-0.1 * (loss - loss.min()))
            wt /= wt.sum()
        return {"mixed": out}

    o = lambda n: F.avg("p").over(ind.w().rowsBetween(-n, -1))
    rows = returns(spark, sf).where("r is not null").withColumn("p", F.greatest(F.col("r") * F.col("r"), F.lit(1e-8)))
    rows = rows.withColumns({"a": o(5), "b": o(20), "c": o(100), "k": F.row_number().over(ind.w())}).where("k > 100")
    return rounded(ind.per_symbol(rows, ["p", "a", "b", "c"], {"mixed": "double"}, f))


@query("har18_machine_learning")
def machine_learning(spark, sf):
    """Boosted trees, random forest and linear regression on lagged features, train before the split."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    rows = log_variance(spark, sf).withColumns({"l1": F.lag("lv").over(ind.w()), "l2": F.lag("lv", 2).over(ind.w())}).dropna()
    rows = VectorAssembler(inputCols=["lv", "lw", "lm", "l1", "l2"], outputCol="features").transform(rows).withColumn("train", F.col("day") < F.lit("1999-10-13").cast("date"))
    out = None
    for name, m in (("linear", LinearRegression(labelCol="y", regParam=0.01)), ("forest", RandomForestRegressor(labelCol="y", numTrees=10, maxDepth=4, seed=1)), ("boosted", GBTRegressor(labelCol="y", maxIter=5, maxDepth=3, seed=1))):
        p = m.fit(rows.where("train")).transform(rows.where("not train"))
        s = p.groupBy(F.lit(name).alias("model")).agg(F.avg(F.pow(F.col("y") - F.col("prediction"), F.lit(2))).alias("mse"), F.count(F.lit(1)).alias("n"))
        out = s if out is None else out.unionByName(s)
    return out


@query("har19_feature_table", LV + " select symbol, day, round(lag(lv) over w, 6) as l1, round(lag(lv, 5) over w, 6) as l5, (symbol = 'A')::integer as is_a, (symbol = 'N')::integer as is_n, round(lv - avg(lv) over (partition by day), 6) as cross_gap from v window w as (partition by symbol order by day)")
def feature_table(spark, sf):
    v = log_variance(spark, sf)
    return rounded(v.select("symbol", "day", F.lag("lv").over(ind.w()).alias("l1"), F.lag("lv", 5).over(ind.w()).alias("l5"), (F.col("symbol") == "A").cast("int").alias("is_a"), (F.col("symbol") == "N").cast("int").alias("is_n"), (F.col("lv") - F.avg("lv").over(Window.partitionBy("day"))).alias("cross_gap")))


YEARLY = LV + ", f as (select year(a.day)::integer as year, a.symbol, regr_slope(b.y, b.lw) as slope, regr_intercept(b.y, b.lw) as icpt from (select distinct symbol, date_trunc('year', day) as day from h) a join h b on a.symbol = b.symbol and b.day < a.day and b.lw is not null and b.y is not null group by 1, 2)"


@query("har20_yearly_refit", YEARLY + " select symbol, year, round(slope, 5) as slope, round(icpt, 5) as intercept from f where slope is not null")
def yearly_refit(spark, sf):
    v = log_variance(spark, sf)
    # Sums per year, added up over the years before: no self-join of rows.
    ok = v.where("lw is not null and y is not null").groupBy("symbol", F.year("day").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("lw").alias("x"), F.sum("y").alias("y"), F.sum(F.col("lw") * F.col("lw")).alias("xx"), F.sum(F.col("lw") * F.col("y")).alias("xy")
    )
    years = v.select("symbol", F.year("day").alias("year")).distinct()
    before = Window.partitionBy("symbol").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    s = years.join(ok, ["symbol", "year"], "left").select("symbol", "year", *[F.sum(c).over(before).alias(c) for c in ("n", "x", "y", "xx", "xy")])
    slope = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("n") * F.col("xx") - F.col("x") * F.col("x"))
    s = s.where("n is not null").withColumn("slope", slope)
    return rounded(s.select("symbol", "year", "slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("n")).alias("intercept")), 5)


@query("har21_spillover", ssql.spillover(LV) + ' select year::integer as year, to_ as "to", from_ as "from", round(share, 6) as share from share')
def spillover_shares(spark, sf):
    return rounded(spillover(spark, sf))


def spillover(spark, sf):
    """VAR(1) of log variances and its generalised decomposition, refit by year."""
    shares = panel.spillover(log_variance(spark, sf), F.year("day"))
    return shares.withColumnRenamed("block", "year")


@query("har21_spillover_blocks", ssql.spillover(LV, block="k // 21", among="f") + ' select year::bigint as block, to_ as "to", from_ as "from", round(share, 6) as share from share')
def spillover_blocks(spark, sf):
    """The same, refit every 21 common days from sums of products by block."""
    return rounded(panel.spillover(log_variance(spark, sf), F.floor(F.col("k") / 21)))


@query("har10_configuration_grid", ssql.configuration_grid(LV))
def configuration_grid(spark, sf):
    """Loss of 64 configurations: weekday factors, window, other symbols, events, shrinkage to the panel, recalibration."""
    v = log_variance(spark, sf).select("symbol", "day", "lv")
    dow = F.weekday("day")
    m = v.where(F.col("day") < F.lit("1999-10-13").cast("date")).groupBy("symbol", dow.alias("dow")).agg(F.percentile("lv", F.lit(0.5)).alias("m"))
    m = m.select("symbol", "dow", (F.col("m") - F.avg("m").over(Window.partitionBy("symbol"))).alias("factor"))
    event = ((dow == 4) & (F.dayofmonth("day") <= 7)).cast("double")
    rows = v.withColumns({"dow": dow, "event": event}).join(F.broadcast(m), ["symbol", "dow"], "left")  # seven rows a symbol
    return rounded(panel.forecast_grid(rows), 5)


S = RETURNS + """, s as (select symbol, day, r, case when count(r) over w = 60 then stddev_pop(r) over w end as sigma from ret window w as (partition by symbol order by day rows between 60 preceding and 1 preceding)),
  g as (select *, case when n = 5 then r5 end as rh from (select *, sum(r) over w as r5, count(r) over w as n from s window w as (partition by symbol order by day rows between current row and 4 following))),
  q as (select symbol, quantile_cont(sigma, [0.3333, 0.6667]) as q from s where day < date '1999-10-13' group by 1), c as (select g.*, case when sigma is not null then len(list_filter(q, lambda x: x <= sigma)) end as regime, case when day < date '1999-10-13' then rh / (sigma * sqrt(5)) end as z from g join q using (symbol)),
  d as (select *, case when count(z) over o >= 100 then stddev_pop(z) over o else stddev_pop(z) over (partition by symbol) end as c, case when count(sigma) over b >= 60 then 0.4::double * quantile_cont(sigma, 0.5) over b end as band from c
    window o as (partition by symbol, regime), b as (partition by symbol order by day rows between 251 preceding and current row))"""


def targets(spark, sf):
    from marketloom.operators import aggregates

    o, h = ind.w().rowsBetween(-60, -1), ind.w().rowsBetween(0, 4)
    rows = returns(spark, sf).withColumn("sigma", F.when(F.count("r").over(o) == 60, F.stddev_pop("r").over(o)))
    rows = rows.withColumn("rh", F.when(F.count("r").over(h) == 5, F.sum("r").over(h)))
    train = F.col("day") < F.lit("1999-10-13").cast("date")
    q = rows.where(train).groupBy("symbol").agg(F.percentile("sigma", F.array(F.lit(0.3333), F.lit(0.6667))).alias("q"))
    rows = rows.join(F.broadcast(q), "symbol").withColumn("regime", aggregates.digitize(F.col("sigma"), F.col("q")))  # a row per symbol
    rows = forecast.horizon_scale(rows, "rh", "sigma", 5, train, "regime")
    return forecast.band(rows, "sigma", k=0.4)


@query("p301_302_scale_and_band", S + " select symbol, day, regime::integer as regime, round(c, 5) as c, round(band, 6) as band from d")
def scale_and_band(spark, sf):
    return targets(spark, sf).select("symbol", "day", "regime", F.round("c", 5).alias("c"), F.round("band", 6).alias("band"))


LABEL = "case when rh < -band * sqrt(5) then 0 when abs(rh) <= band * sqrt(5) then 1 when rh > band * sqrt(5) then 2 end"


@query("p303_304_labels", S + f" select symbol, day, {LABEL} as y_price, case when rh / (sigma * sqrt(5) * c) < -0.43 then 0 when abs(rh / (sigma * sqrt(5) * c)) <= 0.43 then 1 when rh / (sigma * sqrt(5) * c) > 0.43 then 2 end as y_scaled from d")
def labels(spark, sf):
    t = targets(spark, sf)
    z = F.col("rh") / (F.col("sigma") * F.sqrt(F.lit(5.0)) * F.col("c"))
    return t.select("symbol", "day", forecast.label(F.col("rh"), F.col("band") * F.sqrt(F.lit(5.0))).alias("y_price"), forecast.label(z, F.lit(0.43)).alias("y_scaled"))


@query("p305_climatology", BINS + " select symbol, round(avg((bin = 0)::integer), 6) as p0, round(avg((bin = 1)::integer), 6) as p1, round(avg((bin = 2)::integer), 6) as p2 from b where bin is not null and day < date '1999-10-13' group by 1")
def climatology(spark, sf):
    return rounded(forecast.frozen_class_rates(binned(spark, sf), "bin", F.col("day") < F.lit("1999-10-13").cast("date"), ["symbol"]))


@query("p306_persistence", BINS + """, t as (select symbol, lag(bin) over (partition by symbol order by day) as prev, bin as cur, day from b), n as (select symbol, prev, cur, count(*) as n from t where prev is not null and cur is not null and day < date '1999-10-13' group by 1, 2, 3)
  select symbol, prev, cur, round((n + 1) / (sum(n) over (partition by symbol, prev) + 3)::double, 6) as p from n""")
def persistence(spark, sf):
    from marketloom.operators import aggregates

    b = binned(spark, sf).where(F.col("day") < F.lit("1999-10-13").cast("date"))
    return rounded(aggregates.transitions(b, "bin").select("symbol", "prev", "cur", "p"))


EDGE = "(band / sigma * sqrt(1.5))"


@query("p307_student_classes", S + f" select symbol, day, round({ssql.t6_cdf('-' + EDGE)}, 6) as p0, round({ssql.t6_cdf(EDGE)} - {ssql.t6_cdf('-' + EDGE)}, 6) as p1, round(1 - {ssql.t6_cdf(EDGE)}, 6) as p2 from d where band is not null and sigma is not null")
def student(spark, sf):
    t = student_probabilities(targets(spark, sf).where("band is not null and sigma is not null"))
    return rounded(t.select("symbol", "day", "p0", "p1", "p2"))


def student_probabilities(rows):
    """p0, p1, p2 of a scaled Student t with 6 degrees of freedom, whose integral is closed."""

    def below(x):  # of a t with deviation 1
        t2 = x * x * 1.5
        c2 = 6 / (6 + t2)
        return 0.5 + x * 1.5**0.5 / F.sqrt(6 + t2) / 2 * (1 + c2 / 2 + 0.375 * c2 * c2)

    edge = F.col("band") / F.col("sigma")
    return rows.withColumns({"p0": below(-edge), "p1": below(edge) - below(-edge), "p2": 1 - below(edge)})


@query("p308_regime_cdf", S + ", e as (select symbol, regime, count(*) as n, avg((rh / (sigma * sqrt(5) * c) <= -0.43)::integer) as p0, avg((rh / (sigma * sqrt(5) * c) > 0.43)::integer) as p2 from d where day < date '1999-10-13' and rh is not null and sigma is not null group by 1, 2 having count(*) >= 50) select symbol, regime::integer as regime, n, round(p0, 6) as p0, round(1 - p0 - p2, 6) as p1, round(p2, 6) as p2 from e")
def regime_cdf(spark, sf):
    t = targets(spark, sf).where("rh is not null and sigma is not null").where(F.col("day") < F.lit("1999-10-13").cast("date"))
    z = F.col("rh") / (F.col("sigma") * F.sqrt(F.lit(5.0)) * F.col("c"))
    g = t.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg((z <= -0.43).cast("double")).alias("p0"), F.avg((z > 0.43).cast("double")).alias("p2")).where("n >= 50")
    return rounded(g.select("symbol", "regime", "n", "p0", (1 - F.col("p0") - F.col("p2")).alias("p1"), "p2"))


@query("p309_expanding_refit", BINS + """, k as (select *, row_number() over (partition by symbol order by day) - 1 as place from b), l as (select *, case when place >= 750 then (place - 750) // 21 else -1 end as block from k),
  a as (select symbol, block, count(bin) as n, count(*) filter (bin = 2) as k2 from l group by 1, 2), c as (select symbol, block, sum(k2) over w / sum(n) over w as p2 from a window w as (partition by symbol order by block rows between unbounded preceding and 1 preceding)) select symbol, day, round(p2, 6) as p2 from l join c using (symbol, block) where block >= 0""")
def expanding_refit(spark, sf):
    return rounded(forecast.refit_rates(binned(spark, sf), "bin").select("symbol", "day", "p2"))


@query("p310_online_mixture", ssql.online_mixture(BINS))
def online_mixture(spark, sf):
    """Fixed-share mixture of three fixed experts with outcomes five rows late."""
    experts = np.array([[0.34, 0.33, 0.33], [0.6, 0.2, 0.2], [0.2, 0.2, 0.6]])

    def f(y):
        labels = np.where(np.isnan(y), -1, y).astype(int)
        p, weights = recursive.share_experts(np.repeat(experts[:, None, :], len(y), 1), labels, delay=5, share=0.01)
        return {"p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2], "w0": weights[:, 0]}

    return rounded(ind.per_symbol(binned(spark, sf).select("symbol", "day", F.col("bin").cast("double").alias("y")), ["y"], dict.fromkeys(("p0", "p1", "p2", "w0"), "double"), f))


@query("p313_stacked_classifier")
def stacked(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = binned(spark, sf).withColumns({"l1": F.lag("bin").over(ind.w()).cast("double"), "l2": F.lag("bin", 2).over(ind.w()).cast("double"), "label": F.col("bin").cast("double")}).dropna(subset=["l1", "l2", "label"])
    rows = VectorAssembler(inputCols=["l1", "l2"], outputCol="features").transform(rows).withColumn("train", F.col("day") < F.lit("1999-10-13").cast("date"))
    p = LogisticRegression(maxIter=20, regParam=0.01, family="multinomial").fit(rows.where("train")).transform(rows)
    return p.groupBy("train").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


@query("p314_next_session", RETURNS + ", l as (select symbol, max(day) as day from daily group by 1), s as (select symbol, stddev_samp(r) as sigma from (select *, row_number() over (partition by symbol order by day desc) as k from ret) where k <= 60 group by 1) select symbol, (day + case isodow(day) when 5 then 3 when 6 then 2 else 1 end)::date as next_day, round(sigma, 6) as sigma from l join s using (symbol)")
def next_session(spark, sf):
    from marketloom.operators import quality

    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("day").desc()))
    g = returns(spark, sf).withColumn("k", k).where("k <= 60").groupBy("symbol").agg(F.max("day").alias("day"), F.stddev_samp("r").alias("sigma"))
    return rounded(g.select("symbol", quality.next_session("day").alias("next_day"), "sigma"))


@query("inf14_isotonic", f"with {PB}" + ssql.ISOTONIC)
def isotonic(spark, sf):
    from pyspark.ml.regression import IsotonicRegression

    b = binary(spark, sf).select(F.col("p").alias("features"), F.col("y").cast("double").alias("label"))
    m = IsotonicRegression().fit(b)
    return rounded(m.transform(b).groupBy(F.floor(F.col("features") * 10).alias("bin")).agg(F.avg("prediction").alias("calibrated"), F.count(F.lit(1)).alias("n")))


@query("inf16_poolability", LV + """, v2 as (select * from h where lw is not null and y is not null and day < date '1999-10-13'), o as (select symbol, regr_syy(y, lw) - regr_sxy(y, lw) ** 2 / regr_sxx(y, lw) as rss, count(*) as n from v2 group by 1),
  t as (select sum(rss) as own, sum(n)::double as n, count(*)::double as k from o), q as (select regr_syy(y, lw) - regr_sxy(y, lw) ** 2 / regr_sxx(y, lw) as pooled from v2)
  select round((pooled - own) / (2 * (k - 1)) / (own / (n - 2 * k)), 5) as f, (2 * (k - 1))::bigint as df1, (n - 2 * k)::bigint as df2 from t, q""")
def poolability(spark, sf):
    """Chow F that the regression of the next day on the week is the same for all symbols."""
    v = log_variance(spark, sf).where("lw is not null and y is not null").where(F.col("day") < F.lit("1999-10-13").cast("date"))
    rss = (F.regr_syy("y", "lw") - F.regr_sxy("y", "lw") * F.regr_sxy("y", "lw") / F.regr_sxx("y", "lw")).alias("rss")
    own = v.groupBy("symbol").agg(rss, F.count(F.lit(1)).alias("n")).agg(F.sum("rss").alias("own"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    both = own.crossJoin(v.agg(rss.alias("pooled")))  # one row each
    d1, d2 = 2 * (F.col("k") - 1), F.col("n") - 2 * F.col("k")
    return rounded(both.select(((F.col("pooled") - F.col("own")) / d1 / (F.col("own") / d2)).alias("f"), d1.alias("df1"), d2.alias("df2")), 5)


@query("src16_simulated_bars", ssql.simulated_bars())
def simulated(spark, sf):
    """Geometric Brownian bars of known volatility, and what the estimators make of it."""
    n = spark.range(64 * 390).withColumns({"day": F.floor(F.col("id") / 390), "r": hashed.normal(hashed.digest(F.lit("bars"), F.col("id"))) * 0.01 / 390**0.5})
    p = n.withColumn("p", F.exp(F.sum("r").over(Window.partitionBy("day").orderBy("id"))))
    b = p.groupBy("day").agg(F.min_by("p", "id").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "id").alias("close")).withColumn("symbol", F.lit("sim"))
    e = bars.estimators(b)
    return rounded(e.groupBy("symbol").agg(F.sqrt(F.avg("parkinson")).alias("parkinson"), F.sqrt(F.avg("gk")).alias("gk"), F.lit(0.01).alias("truth")), 8)


@query("src17_simulated_garch", ssql.simulated_garch())
def simulated_garch(spark, sf):
    def f(z):
        v, out = 1e-4, np.empty(len(z))
        for t in range(len(z)):
            out[t] = v
            v = 1e-6 + 0.08 * v * z[t] ** 2 + 0.91 * v
        return {"variance": out, "r": np.sqrt(out) * z}

    z = spark.range(2000).select(F.lit("sim").alias("symbol"), F.col("id").alias("day"), hashed.normal(hashed.digest(F.lit("garch"), F.col("id"))).alias("z"))
    return rounded(ind.per_symbol(z, ["z"], {"variance": "double", "r": "double"}, f), 9, r=8)
