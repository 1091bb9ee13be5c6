"""Tail models, nested tests, forecasting grids and decision records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import hashed, special, tails
from marketloom.operators import forecast, scoring, surprises
from marketloom.operators import indicators as ind
from marketloom.plans import series_sql as ssql
from marketloom.plans.catalog import query, rounded
from marketloom.plans.forecast_queries import LV, log_variance
from marketloom.plans.relational_queries import BINS, RETURNS, returns
from marketloom.plans.research_queries import CAP, RULES, SIZ, _cap_constant, rule_rows, sized
from marketloom.plans.score_queries import P3, three_class
from marketloom.sources import frames


def _fits(spark, sf, f, schema: str):
    """One small fit per symbol; a fit needs its whole series."""
    return returns(spark, sf).where("r is not null").select("symbol", "day", "r").groupBy("symbol").applyInPandas(lambda pdf: f(pdf["symbol"].iloc[0], pdf.sort_values("day")["r"].to_numpy()), schema)


@query("var09_autoregressive_quantiles")
def caviar(spark, sf):
    def f(s, z):
        rows = []
        for kind in ("sav", "as", "ig"):
            b, loss = tails.fit_quantile(kind, z[:1000], 0.05, tries=60)
            q = tails.quantile_path(kind, b, z, float(np.quantile(z[:1000], 0.05)))
            rows.append((s, kind, loss, float((z[1000:] <= q[1000:]).mean()) if len(z) > 1000 else None))
        return pd.DataFrame(rows, columns=["symbol", "kind", "loss", "rate"])

    return _fits(spark, sf, f, "symbol string, kind string, loss double, rate double")


@query("var11_score_driven_scale", ssql.score_scale(RETURNS, tails.RESPONSES.tolist(), tails.MEMORIES.tolist()))
def score_scale(spark, sf):
    def f(s, z):
        response, memory, level = tails.fit_scale(z[:800])
        scale = tails.scale_paths(z, np.array([response]), np.array([memory]), 6.0, level)[:, 0]
        q = special.t_quantile(0.05, 6.0) * scale
        return pd.DataFrame([(s, response, memory, level, float((z <= q).mean()))], columns=["symbol", "response", "memory", "level", "rate"])

    return rounded(_fits(spark, sf, f, "symbol string, response double, memory double, level double, rate double"), 6, response=9, memory=9)


@query("var08_quantile_tracking", ssql.tracking(RETURNS))
def tracking(spark, sf):
    def f(r):
        return {"tracked": tails.track_quantile(r, 0.05, 0.05), "mixed": tails.aggregate_trackers(r, 0.05)}

    return rounded(ind.per_symbol(returns(spark, sf).where("r is not null"), ["r"], {"tracked": "double", "mixed": "double"}, f))


@query("cnf04_online_sets", ssql.online_sets(P3))
def online_sets(spark, sf):
    def f(y, p0, p1, p2):
        size, covered, level = tails.online_sets(1 - np.stack([p0, p1, p2], 1), y.astype(int))
        return {"size": size, "covered": covered, "level": level}

    rows = three_class(spark, sf).withColumn("y", F.col("y").cast("double"))
    out = ind.per_symbol(rows, ["y", "p0", "p1", "p2"], dict.fromkeys(("size", "covered", "level"), "double"), f).where("size is not null")
    return rounded(out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("covered").alias("coverage"), F.avg("size").alias("mean_size"), F.avg("level").alias("level")))


@query("inf08_clustered_test", ssql.clustered(BINS))
def clustered(spark, sf):
    """Does a falling last state say more about a rise than the month's level does?"""
    rows, _ = rule_rows(spark, sf)
    rows = rows.where("l1 is not null and bin is not null").select("symbol", F.date_format("day", "yyyyMM").cast("int").alias("month"), (F.col("l1") == 0).cast("double").alias("x"), (F.col("bin") == 2).cast("double").alias("y"), F.col("nb").cast("double").alias("c"))

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        b, t = tails.clustered_t(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["month"].to_numpy(), pdf[["c"]].to_numpy())
        return pd.DataFrame([(pdf["symbol"].iloc[0], b, t)], columns=["symbol", "b", "t"])

    return rounded(rows.groupBy("symbol").applyInPandas(f, "symbol string, b double, t double"), 6, t=4)


@query("inf09_granger", ssql.granger(RETURNS))
def granger(spark, sf):
    """F that the lags of one symbol say nothing about another, given its own."""
    r = returns(spark, sf).where("r is not null")
    effect = r.select("day", F.col("symbol").alias("effect"), F.col("r").alias("y"))
    long = r.select("day", F.col("symbol").alias("cause"), F.col("r").alias("x")).join(effect, "day").where("cause <> effect")  # a day has few symbols

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        a, b = pdf["cause"].iloc[0], pdf["effect"].iloc[0]
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        lag = lambda v: np.stack([v[3 - k : len(v) - k] for k in (1, 2, 3)], 1)
        stat, d1, d2 = tails.nested_f(y[3:], lag(y), np.hstack([lag(y), lag(x)]))
        p = float(special.incomplete_beta(d2 / 2, d1 / 2, np.array(d2 / (d2 + d1 * stat))))
        return pd.DataFrame([(a, b, float(stat), p)], columns=["cause", "effect", "f", "p"])

    return rounded(long.groupBy("cause", "effect").applyInPandas(f, "cause string, effect string, f double, p double"), 5, f=4)


@query("inf10_partial_correlation", RETURNS + """, w as (select day, max(r) filter (symbol = 'A') as a, max(r) filter (symbol = 'N') as n, max(r) filter (symbol = 'R') as s from ret group by 1), c as (select corr(a, n) as an, corr(a, s) as a_s, corr(n, s) as ns from w where a is not null and n is not null and s is not null) select round((an - a_s * ns) / sqrt((1 - a_s ** 2) * (1 - ns ** 2)), 6) as partial, round(an, 6) as plain from c""")
def partial(spark, sf):
    w = returns(spark, sf).groupBy("day").agg(*[F.max(F.when(F.col("symbol") == s, F.col("r"))).alias(s) for s in "ANR"]).dropna()
    c = w.agg(F.corr("A", "N").alias("an"), F.corr("A", "R").alias("ar"), F.corr("N", "R").alias("nr"))
    return rounded(c.select(((F.col("an") - F.col("ar") * F.col("nr")) / F.sqrt((1 - F.col("ar") ** 2) * (1 - F.col("nr") ** 2))).alias("partial"), F.col("an").alias("plain")))


@query("inf15_detectable_effect", ssql.detectable())
def detectable(spark, sf):
    """Share of simulated samples in which a planted lift is found, by size of lift."""
    rows = spark.range(0, 5 * 64 * 2000, numPartitions=16).select(F.floor(F.col("id") / 2000).alias("draw"), (F.col("id") % 2000).alias("k"))
    u = hashed.half(hashed.digest(F.lit("power"), F.col("draw"), F.col("k")))
    step = F.col("draw") % 5
    m = rows.groupBy("draw", step.alias("step")).agg(F.avg((u < F.lit(1 / 3) * (1 + 0.05 * step)).cast("double")).alias("m"))
    found = (F.col("m") - 1 / 3) / (2 / 9 / 2000) ** 0.5 > 1.96
    return m.groupBy(F.round(1 + 0.05 * F.col("step"), 2).alias("lift")).agg(F.round(F.avg(found.cast("double")), 6).alias("power"), F.count(F.lit(1)).alias("samples"))


@query("har14_qlike_regression")
def qlike_regression(spark, sf):
    rows = log_variance(spark, sf).where("lw is not null and lm is not null and y is not null").select("symbol", F.year("day").alias("year"), "day", "lv", "lw", "lm", "y")
    last = F.broadcast(rows.agg(F.max("year").alias("last")))  # one row
    fits = rows.crossJoin(last).withColumn("upto", F.explode(F.sequence(F.col("year") + 1, F.col("last") + 1))).where("upto <= last")

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        b = tails.qlike_har(pdf[["lv", "lw", "lm"]].to_numpy(), np.exp(pdf["y"].to_numpy()))
        return pd.DataFrame([(pdf["symbol"].iloc[0], int(pdf["upto"].iloc[0]), *map(float, b))], columns=["symbol", "year", "b0", "b1", "b2", "b3"])

    beta = fits.groupBy("symbol", "upto").applyInPandas(f, "symbol string, year int, b0 double, b1 double, b2 double, b3 double")
    p = rows.join(beta, ["symbol", "year"])
    h = F.exp(F.col("b0") + F.col("b1") * F.col("lv") + F.col("b2") * F.col("lw") + F.col("b3") * F.col("lm"))
    return p.groupBy("symbol", "year").agg(F.avg(scoring.qlike_ratio(h, F.exp("y"))).alias("qlike"), F.count(F.lit(1)).alias("n"))


@query("har08_10_forecast_grid", ssql.forecast_grid(LV))
def forecast_grid(spark, sf):
    """Loss by window and recalibration; a forecast goes to the next session only within four days."""
    x, out = ["lv", "lw", "lm"], None
    base = log_variance(spark, sf).withColumn("gap", F.datediff(F.lead("day").over(ind.w()), "day"))
    for window in (None, 250, 750):
        p = forecast.predict(forecast.expanding_ols(base, x, "y", window=window), x, "g").drop("beta")
        p = forecast.simple_ols(p, "g", "y")
        s2 = F.var_samp(F.col("y") - F.col("g")).over(ind.w().rowsBetween(Window.unboundedPreceding, -1))
        p = p.withColumn("level", F.exp(F.col("g") + 0.5 * s2)).where("gap <= 4 and y is not null and g is not null and slope is not null")
        loss = lambda f: F.avg(F.exp(F.col("y") - f) - (F.col("y") - f) - 1)
        g = p.groupBy("symbol").agg(loss(F.col("g")).alias("plain"), loss(F.col("intercept") + F.col("slope") * F.col("g")).alias("recalibrated"), F.avg("level").alias("mean_level"), F.count(F.lit(1)).alias("n")).withColumn("window", F.lit(window or 0))
        out = g if out is None else out.unionByName(g)
    return rounded(out, 5)


@query("har23_shadow_log", LV + ", f as (select symbol, day, lw as forecast from h where year(day) = 2000 and lw is not null), o as (select symbol, day, y from h where y is not null) select symbol, day, round(forecast, 6) as forecast, round(y, 6) as outcome, round(abs(forecast - y), 6) as error from f left join o using (symbol, day)")
def shadow(spark, sf):
    """Forecasts and outcomes are two append-only tables; the log is their join."""
    v = log_variance(spark, sf)
    f = v.where("year(day) = 2000 and lw is not null").select("symbol", "day", F.col("lw").alias("forecast"))
    o = v.where("y is not null").select("symbol", "day", F.col("y").alias("outcome"))
    return rounded(f.join(o, ["symbol", "day"], "left").withColumn("error", F.abs(F.col("forecast") - F.col("outcome"))))


@query("txt07_surprise", f"with {frames.CALENDAR}, c as (select day, count(*) as n from calendar group by 1) select day, n, n - lag(n) over (order by day) as change, round(n - avg(n) over (order by day rows between 10 preceding and 1 preceding), 6) as surprise from c")
def surprise(spark, sf):
    c = frames.calendar(spark, sf).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("day")  # one row per calendar day
    return rounded(c.select("day", "n", (F.col("n") - F.lag("n").over(w)).alias("change"), (F.col("n") - F.avg("n").over(w.rowsBetween(-10, -1))).alias("surprise")))


@query(
    "txt07_market_surprise",
    f"""with {frames.DAILY}, {frames.CALENDAR}, moves as (select symbol, day, 10000 * (close / lag(close) over (partition by symbol order by day) - 1) as move
      from daily where symbol in ('A', 'N', 'R')), found as (select day, max(move) filter (symbol = 'A') as surprise, max(abs(move)) filter (symbol = 'A') as abs_surprise,
      max(abs(move)) filter (symbol = 'N') as abs_n, max(abs(move)) filter (symbol = 'R') as abs_r from moves where day in (select day from calendar) group by day)
    select day, round(surprise, 6) as surprise, round(abs_surprise, 6) as abs_surprise, round(abs_n, 6) as abs_n, round(abs_r, 6) as abs_r from found where surprise is not null""",
)
def market_surprise(spark, sf):
    return rounded(surprises.market_surprises(frames.calendar(spark, sf), frames.daily(spark, sf), "A", ["N", "R"]))


@query("rul08_gate_funnel", RULES.replace("select rule, y, n, hits, round", "select count(*) as candidates, count(*) filter (lift >= 1.05) as lifted, count(*) filter (lift >= 1.05 and z >= 2) as sure, count(*) filter (lift >= 1.05 and z >= 4) as surer from (select rule, y, n, hits, round") + ")")
def funnel(spark, sf):
    from marketloom.operators import research

    rows, features = rule_rows(spark, sf)
    r = rounded(research.rules(rows, features, "bin"), 6, z=5)
    gate = lambda c: F.count_if(c)
    up = F.col("lift") >= 1.05
    return r.agg(F.count(F.lit(1)).alias("candidates"), gate(up).alias("lifted"), gate(up & (F.col("z") >= 2)).alias("sure"), gate(up & (F.col("z") >= 4)).alias("surer"))


@query("dec06_end_to_end_equity", SIZ + f", f as (select symbol, day, least(greatest(least(mu / (sigma * sigma), {CAP.format(c=_cap_constant())}), 0), 30) as f from s join q using (symbol) where n = 60), g as (select f.symbol, f.day, f * lead(r) over (partition by f.symbol order by f.day) / 100 as pnl from f join ret using (symbol, day)) select symbol, year(day)::integer as year, round(sum(pnl), 5) as pnl, count(pnl) as n from g group by 1, 2")
def equity(spark, sf):
    from marketloom.operators import research

    rows = research.position(sized(spark, sf), F.col("q")[0], F.col("q")[1], F.col("q")[2], F.col("mu"), F.lit(0.0), k=3)
    pnl = F.col("f") * F.lead("r").over(ind.w()) / 100
    g = rows.withColumn("pnl", pnl).groupBy("symbol", F.year("day").alias("year")).agg(F.sum("pnl").alias("pnl"), F.count("pnl").alias("n"))
    return rounded(g, 5)


RECORD = """, l as (select symbol, max(day) as day from f group by 1), x as (select f.* from f join l using (symbol, day))
  select symbol, '{"day":"' || day || '","for":"' || (day + case isodow(day) when 5 then 3 when 6 then 2 else 1 end)::date || '","sigma":"' || printf('%.6f', sigma) || '","size":"' || printf('%.6f', f) || '","rule":"size ' || printf('%.3f', f) || ' bound by ' || binding || '"}' as record from x"""
SIZED = SIZ + f""", f0 as (select symbol, day, sigma, mu / (sigma * sigma) as kelly, {CAP.format(c=_cap_constant())} as cap from s join q using (symbol) where n = 60),
  f as (select *, least(greatest(least(kelly, cap), 0), 30) as f, case when kelly <= 0 then 'no edge' when least(kelly, cap) >= 30 then 'leverage' when kelly < cap then 'kelly' else 'risk cap' end as binding from f0)"""


@query("dec03_05_decision_record", SIZED + RECORD)
def record(spark, sf):
    """The last decision of each symbol as one JSON document."""
    from marketloom.operators import quality, research

    rows = research.position(sized(spark, sf), F.col("q")[0], F.col("q")[1], F.col("q")[2], F.col("mu"), F.lit(0.0), k=3)
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("day", "close", "sigma", "f", "binding"), "day").alias("x"))
    text = lambda c, d: F.format_string(f"%.{d}f", c)
    rule = F.concat(F.lit("size "), text("x.f", 3), F.lit(" bound by "), F.col("x.binding"))
    return last.select("symbol", F.to_json(F.struct(F.col("x.day").alias("day"), quality.next_session("x.day").alias("for"), text("x.sigma", 6).alias("sigma"), text("x.f", 6).alias("size"), rule.alias("rule"))).alias("record"))
