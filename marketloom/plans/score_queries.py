"""Scores, calibration, backtests, conformal prediction and inference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import hashed, special
from marketloom.operators import scoring
from marketloom.operators import indicators as ind
from marketloom.plans import series_sql as ssql
from marketloom.plans.catalog import query, rounded
from marketloom.plans.relational_queries import BINS, RETURNS, binned, returns
from marketloom.sources import frames

P3 = BINS + """, u as (select symbol, day, bin as y, ((day - date '1970-01-01') * 7919 % 1000) / 1000::double as u from b where bin is not null),
  p as (select symbol, day, y, (1 - (0.2::double + 0.6::double * u)) * 0.4::double as p0, 0.2::double + 0.6::double * u as p1, (1 - (0.2::double + 0.6::double * u)) * 0.6::double as p2 from u)"""


def three_class(spark, sf):
    """symbol, day, y and a fixed made-up distribution: for testing scores only."""
    u = F.unix_date("day") * 7919 % 1000 / F.lit(1000.0)
    p1 = F.lit(0.2) + F.lit(0.6) * u
    rows = binned(spark, sf).where("bin is not null")
    return rows.select("symbol", "day", F.col("bin").alias("y"), ((1 - p1) * F.lit(0.4)).alias("p0"), p1.alias("p1"), ((1 - p1) * F.lit(0.6)).alias("p2"))


PB = "b2 as (select doc_id, quality as y, toxic as s, (n_chars % 997) / 997::double as p from labels join documents using (doc_id))"


def binary(spark, sf):
    docs, labels = frames.table(spark, sf, "documents"), frames.table(spark, sf, "labels")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("s"), (F.col("n_chars") % 997 / F.lit(997.0)).alias("p"))


VOL = RETURNS + """, v as (select symbol, day, r, avg(r * r) over (partition by symbol order by day rows between 20 preceding and 1 preceding) as h, count(r) over (partition by symbol order by day rows between 20 preceding and 1 preceding) as n from ret),
  vv as (select symbol, day, r, h, greatest(r * r, 1e-8) as p from v where n = 20 and r is not null)"""


def vol_forecast(spark, sf):
    o = ind.w().rowsBetween(-20, -1)
    rows = returns(spark, sf).withColumns({"h": F.avg(F.col("r") * F.col("r")).over(o), "n": F.count("r").over(o)})
    return rows.where("n = 20 and r is not null").select("symbol", "day", "r", "h", F.greatest(F.col("r") * F.col("r"), F.lit(1e-8)).alias("p"))


@query("scr01_qlike_mse_mae", VOL + " select symbol, round(avg(ln(h) + p / h), 6) as qlike, round(avg(p / h - ln(p / h) - 1), 6) as qlike_ratio, round(avg((p - h) ** 2), 6) as mse, round(avg(abs(p - h)), 6) as mae, count(*) as n from vv group by 1")
def qlike(spark, sf):
    h, p = F.col("h"), F.col("p")
    return rounded(vol_forecast(spark, sf).groupBy("symbol").agg(F.avg(scoring.qlike(h, p)).alias("qlike"), F.avg(scoring.qlike_ratio(h, p)).alias("qlike_ratio"), F.avg(F.pow(p - h, F.lit(2))).alias("mse"), F.avg(F.abs(p - h)).alias("mae"), F.count(F.lit(1)).alias("n")))


TAUS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(
    "scr02_pinball_crps_grid",
    RETURNS + """, q as (select symbol, day, r, list_transform([0.05, 0.25, 0.5, 0.75, 0.95], lambda t: t::double) as t, quantile_cont(r, [0.05, 0.25, 0.5, 0.75, 0.95]) over w as q, count(r) over w as n from ret window w as (partition by symbol order by day rows between 120 preceding and 1 preceding)),
    l as (select symbol, day, list_transform(range(1, 6), lambda i: greatest(t[i] * (r - q[i]), (t[i] - 1) * (r - q[i]))) as l from q where n = 120 and r is not null)
    select symbol, round(avg(l[3]), 6) as pinball_median, round(avg(2 * ((l[1] + l[2]) / 2 * 0.2 + (l[2] + l[3]) / 2 * 0.25 + (l[3] + l[4]) / 2 * 0.25 + (l[4] + l[5]) / 2 * 0.2)), 6) as crps from l group by 1""",
)
def pinball(spark, sf):
    o = ind.w().rowsBetween(-120, -1)
    rows = returns(spark, sf).withColumns({"q": F.percentile("r", F.array(*map(F.lit, TAUS))).over(o), "n": F.count("r").over(o)}).where("n = 120 and r is not null")
    return rounded(rows.groupBy("symbol").agg(F.avg(scoring.pinball(F.col("q")[2], F.col("r"), F.lit(0.5))).alias("pinball_median"), F.avg(scoring.crps_grid(rows, "q", TAUS, "r")).alias("crps")))


@query("scr03_crps_normal", VOL + f", z as (select symbol, sqrt(h) as s, r / sqrt(h) as z from vv) select symbol, round(avg(s * (z * (2 * {ssql.normal_cdf('z')} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 6) as crps from z group by 1")
def crps_normal(spark, sf):
    @F.pandas_udf("double")
    def crps(y: pd.Series, h: pd.Series) -> pd.Series:
        s = np.sqrt(h)
        z = y / s
        return pd.Series(s * (z * (2 * special.normal_cdf(z) - 1) + 2 * np.exp(-z * z / 2) / np.sqrt(2 * np.pi) - 1 / np.sqrt(np.pi)))

    return rounded(vol_forecast(spark, sf).groupBy("symbol").agg(F.avg(crps("r", "h")).alias("crps")))


@query("scr04_crps_sample", RETURNS + """, x as (select symbol, year(day) as y, r, row_number() over (partition by symbol, year(day) order by r) as i, count(*) over (partition by symbol, year(day)) as n from ret where r is not null) select symbol, y::integer as year, round(avg(abs(r - 0.01)) - sum((2 * i - n - 1) * r) / (count(*) * count(*)), 6) as crps from x group by 1, 2""")
def crps_sample(spark, sf):
    r = returns(spark, sf).where("r is not null").select("symbol", F.year("day").alias("year"), "r", F.lit(0.01).alias("y"))
    return rounded(scoring.crps_sample(r, "r", "y", ("symbol", "year")))


@query(
    "scr06_log_brier_skill",
    P3 + """, c as (select symbol, avg((y = 0)::integer) as c0, avg((y = 1)::integer) as c1, avg((y = 2)::integer) as c2 from p group by 1),
    s as (select symbol, -ln(greatest(case y when 0 then p0 when 1 then p1 else p2 end, 1e-12)) as l, (p0 - (y = 0)::integer) ** 2 + (p1 - (y = 1)::integer) ** 2 + (p2 - (y = 2)::integer) ** 2 as b, (c0 - (y = 0)::integer) ** 2 + (c1 - (y = 1)::integer) ** 2 + (c2 - (y = 2)::integer) ** 2 as r from p join c using (symbol))
    select symbol, round(avg(l), 6) as log_score, round(avg(b), 6) as brier, round(1 - avg(b) / avg(r), 6) as skill from s group by 1""",
)
def log_brier(spark, sf):
    p = three_class(spark, sf)
    w = Window.partitionBy("symbol")
    clim = [F.avg((F.col("y") == k).cast("double")).over(w).alias(f"c{k}") for k in range(3)]
    p = p.select("*", *clim)
    probs, ref = [F.col(f"p{k}") for k in range(3)], [F.col(f"c{k}") for k in range(3)]
    b, r = scoring.brier(F.col("y"), probs), scoring.brier(F.col("y"), ref)
    return rounded(p.groupBy("symbol").agg(F.avg(scoring.log_score(scoring.picked(F.col("y"), probs))).alias("log_score"), F.avg(b).alias("brier"), scoring.skill(b, r).alias("skill")))


@query("scr07_reliability", f"with {PB} select least(floor(p * 10), 9)::integer as bin, count(*) as n, round(avg(p), 6) as p, round(avg(y), 6) as rate from b2 group by 1")
def reliability(spark, sf):
    return rounded(scoring.reliability(binary(spark, sf), "p", "y"))


@query("scr07_calibration_error", f"with {PB}, g as (select least(floor(p * 10), 9) as bin, count(*) as n, abs(avg(p) - avg(y)) as gap from b2 group by 1 having count(*) >= 20) select round(sum(gap * n) / sum(n), 6) as ece, round(max(gap), 6) as mce from g")
def calibration(spark, sf):
    return rounded(scoring.calibration_error(binary(spark, sf), "p", "y", least=20))


AUC = "select {k} (sum(case when y = 1 then k end) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / nullif(count(*) filter (y = 1) * count(*) filter (y = 0), 0) as auc, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from"


@query("scr08_auc", f"with {PB}, k as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as k from b2) select round(auc, 6) as auc, pos, neg from ({AUC.format(k='')} k)")
def auc(spark, sf):
    return rounded(scoring.auc(binary(spark, sf), "p", "y"))


@query("scr08_stratified_auc", f"with {PB}, k as (select s, y, rank() over (partition by s order by p) + (count(*) over (partition by s, p) - 1) / 2 as k from b2), a as ({AUC.format(k='s,')} k group by s) select round(sum(auc * pos * neg) / sum(pos * neg), 6) as auc, count(*) as strata from a where auc is not null")
def stratified(spark, sf):
    return rounded(scoring.stratified_auc(binary(spark, sf), "p", "y", "s"))


@query("scr09_accuracy_f1", P3 + """, g as (select y, case when p1 >= p0 and p1 >= p2 then 1 when p0 >= p2 then 0 else 2 end as g from p), f as (select c, 2.0::double * count(*) filter (y = c and g = c) / nullif(count(*) filter (g = c) + count(*) filter (y = c), 0) as f from g, (values (0), (1), (2)) v(c) group by 1)
    select round((select avg((y = g)::integer) from g), 6) as accuracy, round(sum(coalesce(f, 0)) / 3, 6) as macro_f1 from f""")
def f1(spark, sf):
    p = three_class(spark, sf)
    guess = F.when((F.col("p1") >= F.col("p0")) & (F.col("p1") >= F.col("p2")), 1).when(F.col("p0") >= F.col("p2"), 0).otherwise(2)
    return rounded(scoring.macro_f1(p.withColumn("g", guess), "y", "g"))


@query("scr10_bootstrap_interval", P3 + ", rows_ as (select symbol, (p0 - (y = 0)::integer) ** 2 + (p1 - (y = 1)::integer) ** 2 + (p2 - (y = 2)::integer) ** 2 as s, row_number() over (partition by symbol order by day) - 1 as i, count(*) over (partition by symbol) as n from p), " + ssql.bootstrapped("rows_", "s", "avg({})", 400, 20))
def bootstrap(spark, sf):
    p = three_class(spark, sf).withColumn("s", scoring.brier(F.col("y"), [F.col(f"p{k}") for k in range(3)]))
    return rounded(scoring.interval(scoring.bootstrap(p, ["s"], np.mean, 400, 20)))


@query("scr11_score_card", P3 + " select year(day)::integer as year, count(*) as n, round(avg(-ln(case y when 0 then p0 when 1 then p1 else p2 end)), 6) as log_score, round(avg(p1), 6) as sharpness from p group by 1 having count(*) >= 200")
def score_card(spark, sf):
    p = three_class(spark, sf)
    ls = scoring.log_score(scoring.picked(F.col("y"), [F.col(f"p{k}") for k in range(3)]))
    return rounded(p.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg(ls).alias("log_score"), F.avg("p1").alias("sharpness")).where("n >= 200"))


TAIL = RETURNS + """, t as (select symbol, day, r, quantile_cont(r, 0.05) over w as q, list(r) over w as x, count(r) over w as n from ret window w as (partition by symbol order by day rows between 250 preceding and 1 preceding)),
  h as (select symbol, day, r, q, list_avg(list_filter(x, lambda v: v <= q)) as es, (r <= q)::integer as hit from t where n = 250 and r is not null)"""


def tail(spark, sf):
    o = ind.w().rowsBetween(-250, -1)
    rows = returns(spark, sf).withColumns({"q": F.percentile("r", F.lit(0.05)).over(o), "x": F.collect_list("r").over(o)}).where("size(x) = 250 and r is not null")
    low = F.filter("x", lambda v: v <= F.col("q"))
    es = F.aggregate(low, F.lit(0.0), lambda a, v: a + v) / F.size(low)
    return rows.select("symbol", "day", "r", "q", es.alias("es"), (F.col("r") <= F.col("q")).cast("int").alias("hit"))


@query("var01_06_kupiec", TAIL + """, k as (select symbol, sum(hit)::double as x, count(*)::double as n from h group by 1) select symbol, x::bigint as hits, n::bigint as n, round(case when x > 0 and x < n then -2 * ((n - x) * ln(0.95) + x * ln(0.05) - (n - x) * ln(1 - x / n) - x * ln(x / n)) end, 6) as lr from k""")
def kupiec(spark, sf):
    g = tail(spark, sf).groupBy("symbol").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("symbol", "hits", "n", scoring.kupiec(F.col("hits").cast("double"), F.col("n").cast("double"), 0.05).alias("lr")))


@query(
    "var02_christoffersen",
    TAIL + """, t2 as (select symbol, lag(hit) over (partition by symbol order by day) as b, hit from h), c as (select symbol, count(*) filter (b = 0 and hit = 0) as n00, count(*) filter (b = 0 and hit = 1) as n01, count(*) filter (b = 1 and hit = 0) as n10, count(*) filter (b = 1 and hit = 1) as n11 from t2 where b is not null group by 1),
    d as (select *, (n01 + n11)::double / (n00 + n01 + n10 + n11) as p, n01::double / nullif(n00 + n01, 0) as p0, n11::double / nullif(n10 + n11, 0) as p1 from c)
    select symbol, n00, n01, n10, n11, round(case when n01 + n11 > 0 and n10 + n11 > 0 then -2 * ((n00 + n10) * ln(1 - p) + (n01 + n11) * ln(p) - case when n00 > 0 then n00 * ln(1 - p0) else 0 end - case when n01 > 0 then n01 * ln(p0) else 0 end - case when n10 > 0 then n10 * ln(1 - p1) else 0 end - case when n11 > 0 then n11 * ln(p1) else 0 end) end, 6) as lr from d""",
)
def christoffersen(spark, sf):
    return rounded(scoring.christoffersen(tail(spark, sf), "hit"))


@query("var03_dynamic_quantile", ssql.dynamic_quantile(TAIL))
def dynamic_quantile(spark, sf):
    """DQ test: hits on four lags and the quantile, chi-square tail of the fit."""
    rows = tail(spark, sf).withColumn("d", F.col("hit") - 0.05)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        d, q = pdf["d"].to_numpy(), pdf["q"].to_numpy()
        x = np.stack([np.ones(len(d) - 4), *[d[4 - k : len(d) - k] for k in range(1, 5)], q[4:]], 1)
        y = d[4:]
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        stat = float(beta @ x.T @ x @ beta / (0.05 * 0.95))
        return pd.DataFrame([(pdf["symbol"].iloc[0], stat, float(special.chi2_tail(stat, 6)))], columns=["symbol", "dq", "p"])

    return rows.select("symbol", "day", "d", "q").groupBy("symbol").applyInPandas(run, "symbol string, dq double, p double").select("symbol", F.round("dq", 4).alias("dq"), F.round("p", 5).alias("p"))


@query("var04_fz0_loss", TAIL + " select symbol, round(avg(-case when r <= q then (q - r) / (0.05 * es) else 0 end + q / es + ln(-es) - 1), 6) as fz0 from h where es < 0 group by 1")
def fz0(spark, sf):
    return rounded(tail(spark, sf).where("es < 0").groupBy("symbol").agg(F.avg(scoring.fz0(F.col("r"), F.col("q"), F.col("es"), 0.05)).alias("fz0")))


@query("var05_backtest_table", TAIL + " select symbol, count(*) as n, cast(sum(hit) as bigint) as hits, round(avg(hit), 6) as rate, round(avg(case when hit = 1 then r end), 6) as mean_loss, round(avg(case when hit = 1 then es end), 6) as mean_es, round(avg(case when hit = 1 then r - es end), 6) as excess from h group by 1")
def backtest(spark, sf):
    on = lambda c: F.avg(F.when(F.col("hit") == 1, c))
    return rounded(tail(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("rate"), on(F.col("r")).alias("mean_loss"), on(F.col("es")).alias("mean_es"), on(F.col("r") - F.col("es")).alias("excess")))


@query("var07_08_adaptive_tails", ssql.adaptive_tails(RETURNS))
def adaptive(spark, sf):
    """ACI and PID filters: rates of hits and mean quantiles."""
    from marketloom.functions import recursive as rec

    def f(r):
        a, p = rec.adaptive_tail(r, 0.05), rec.adaptive_tail(r, 0.05, rec.three_terms(0.05, 0.01, 0.001, 0.002, 0.98))
        return {"aci_q": a[0], "aci_es": a[1], "aci_level": a[2], "pid_q": p[0], "pid_es": p[1], "pid_level": p[2]}

    r = returns(spark, sf).where("r is not null")
    return rounded(ind.per_symbol(r, ["r"], dict.fromkeys(("aci_q", "aci_es", "aci_level", "pid_q", "pid_es", "pid_level"), "double"), f))


@query("var10_generalised_pareto", RETURNS + """, l as (select symbol, -r as loss from ret where r is not null), u as (select symbol, quantile_cont(loss, 0.9) as u, count(*)::double as n from l group by 1), x as (select symbol, loss - u as x, u, n from l join u using (symbol) where loss > u),
  g as (select symbol, avg(x) as m, var_samp(x) as v, any_value(u) as u, any_value(n) as n, count(*)::double as k from x group by 1), s as (select *, 0.5 * (1 - m * m / v) as shape from g)
  select symbol, round(shape, 6) as shape, round(m * (1 - shape), 6) as scale, round(u + m * (1 - shape) / shape * ((n / k * 0.01) ** -shape - 1), 6) as loss99 from s""")
def pareto_tail(spark, sf):
    """Tail by moments of losses beyond the 90 % quantile: shape, scale, and the 99 % loss."""
    r = returns(spark, sf).where("r is not null").withColumn("loss", -F.col("r"))
    u = r.groupBy("symbol").agg(F.percentile("loss", F.lit(0.9)).alias("u"), F.count(F.lit(1)).alias("n"))
    e = r.join(F.broadcast(u), "symbol").where("loss > u").withColumn("x", F.col("loss") - F.col("u"))  # a row per symbol
    g = e.groupBy("symbol").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.first("u").alias("u"), F.first("n").alias("n"), F.count(F.lit(1)).alias("k"))
    shape = 0.5 * (1 - F.col("m") * F.col("m") / F.col("v"))
    g = g.withColumns({"shape": shape, "scale": F.col("m") * (1 - shape)})
    return rounded(g.select("symbol", "shape", "scale", (F.col("u") + F.col("scale") / F.col("shape") * (F.pow(F.col("n") / F.col("k") * 0.01, -F.col("shape")) - 1)).alias("loss99")))


@query("var12_regime_tails", RETURNS + ", g as (select symbol, r, n_bars >= 8 as busy, day between date '1997-01-01' and date '1997-12-31' as event from ret where r is not null) select symbol, busy, count(*) as n, round(quantile_cont(r, 0.05), 6) as q05, round(quantile_cont(case when not event then r end, 0.05), 6) as q05_calm from g group by 1, 2")
def regime_tails(spark, sf):
    r = returns(spark, sf).where("r is not null").withColumn("busy", F.col("n_bars") >= 8)
    calm = F.when(~F.col("day").between(F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date")), F.col("r"))
    return rounded(r.groupBy("symbol", "busy").agg(F.count(F.lit(1)).alias("n"), F.percentile("r", F.lit(0.05)).alias("q05"), F.percentile(calm, F.lit(0.05)).alias("q05_calm")))


CONF = P3 + """, s as (select *, 1 - case y when 0 then p0 when 1 then p1 else p2 end as score, row_number() over (partition by symbol order by 1 - case y when 0 then p0 when 1 then p1 else p2 end) as i, count(*) over (partition by symbol) as n from p where day < date '1999-10-13'),
  t as (select symbol, max(case when i = ceil((n + 1) * 0.9 - 1e-9) then score end) as threshold, max(n) as n from s group by 1)"""


def _conformal(spark, sf):
    p = three_class(spark, sf)
    score = 1 - scoring.picked(F.col("y"), [F.col(f"p{k}") for k in range(3)])
    cut = F.lit("1999-10-13").cast("date")
    return p, scoring.conformal_threshold(p.where(F.col("day") < cut).withColumn("score", score), "score", 0.1, ("symbol",)), cut


@query("cnf01_02_threshold", CONF + " select symbol, round(threshold, 6) as threshold, n from t")
def threshold(spark, sf):
    return rounded(_conformal(spark, sf)[1])


@query("cnf03_05_coverage", CONF + """, c as (select symbol, y, (1 - p0 <= threshold)::integer + (1 - p1 <= threshold)::integer + (1 - p2 <= threshold)::integer as size, (1 - case y when 0 then p0 when 1 then p1 else p2 end <= threshold)::integer as covered from p join t using (symbol) where day >= date '1999-10-13')
    select symbol, count(*) as n, round(avg(covered), 6) as coverage, round(avg(size), 6) as mean_size, round(avg((size = 0)::integer), 6) as empty_rate from c group by 1""")
def coverage(spark, sf):
    p, t, cut = _conformal(spark, sf)
    rows = p.where(F.col("day") >= cut).join(F.broadcast(t), "symbol")  # a row per symbol
    inside = [(1 - F.col(f"p{k}") <= F.col("threshold")).cast("int") for k in range(3)]
    size = inside[0] + inside[1] + inside[2]
    covered = (1 - scoring.picked(F.col("y"), [F.col(f"p{k}") for k in range(3)]) <= F.col("threshold")).cast("double")
    return rounded(rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(covered).alias("coverage"), F.avg(size.cast("double")).alias("mean_size"), F.avg((size == 0).cast("double")).alias("empty_rate")))


@query("cnf06_mondrian_interval", RETURNS + ", g as (select symbol, n_bars >= 8 as busy, abs(r) as z from ret where r is not null and day < date '1999-10-13') select symbol, busy, round(quantile_cont(z, 0.9), 6) as half_width, count(*) as n from g group by 1, 2")
def mondrian(spark, sf):
    r = returns(spark, sf).where("r is not null").where(F.col("day") < F.lit("1999-10-13").cast("date"))
    return rounded(r.groupBy("symbol", (F.col("n_bars") >= 8).alias("busy")).agg(F.percentile(F.abs("r"), F.lit(0.9)).alias("half_width"), F.count(F.lit(1)).alias("n")))


DM = VOL + ", d as (select symbol, day, (ln(h) + p / h) - (ln(0.3) + p / 0.3) as d from vv)"


@query(
    "inf01_diebold_mariano",
    DM + """, m as (select symbol, avg(d) as m, count(*) as n from d group by 1), e as (select symbol, row_number() over (partition by symbol order by day) as k, d - m as e, m, n from d join m using (symbol)),
    g as (select a.symbol, l, any_value(a.n) as n, any_value(a.m) as m, sum(a.e * b.e) / any_value(a.n) as g from e a, range(0, 25) r(l), e b where b.symbol = a.symbol and b.k = a.k - l and l <= ceil(1.5 * a.n ** (1 / 3::double)) group by 1, 2)
    select symbol, round(any_value(m) / sqrt(sum(case when l = 0 then g else 2 * (1 - l / (ceil(1.5 * n ** (1 / 3::double)) + 1)) * g end) / any_value(n)), 5) as dm, any_value(n) as n from g group by 1""",
)
def diebold_mariano(spark, sf):
    h, p = F.col("h"), F.col("p")
    d = vol_forecast(spark, sf).select("symbol", "day", (scoring.qlike(h, p) - scoring.qlike(F.lit(0.3), p)).alias("d"))
    return rounded(scoring.newey_west_dm(d, "d", "symbol", "day"), 5)


def _losses(spark, sf):
    """day, four losses (mean over symbols): one row per day."""
    rows = vol_forecast(spark, sf)
    h, p = F.col("h"), F.col("p")
    loss = {f"m{i}": F.avg(scoring.qlike_ratio(h * c, p)) for i, c in enumerate(SCALES)}
    return rows.groupBy("day").agg(*[v.alias(k) for k, v in loss.items()])


SCALES = (1.0, 0.7, 1.5, 3.0)
LOSSES = VOL + ", ls as (select day, " + ", ".join(f"avg(p / (h * {c!r}::double) - ln(p / (h * {c!r}::double)) - 1) as m{i}" for i, c in enumerate(SCALES)) + " from vv group by 1)"


@query("inf02_03_confidence_set_spa", ssql.confidence_and_superiority(LOSSES, len(SCALES)))
def confidence(spark, sf):
    return rounded(scoring.confidence_and_superiority(_losses(spark, sf), [f"m{i}" for i in range(len(SCALES))], "day"))


PV = "with p as (select l_suppkey as k, exp(-abs(avg(l_discount) - 0.05) * 400) as p from lineitem group by 1)"


@query("inf06_benjamini_hochberg", PV + ", r as (select k, p, row_number() over (order by p, k) as i, count(*) over () as n from p) select k, round(least(1.0, min(p * n / i) over (order by i desc)), 6) as q from r")
def bh(spark, sf):
    p = frames.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.exp(-F.abs(F.avg("l_discount") - 0.05) * 400).alias("p"))
    return rounded(scoring.fdr(p, "p").select("k", "q"))


@query("inf06_benjamini_yekutieli", PV + ", r as (select k, p, row_number() over (order by p, k) as i, count(*) over () as n, (select list_sum(list_transform(range(1, count(*) + 1), lambda j: 1.0::double / j)) from p) as c from p) select k, round(least(1.0, min(p * n * c / i) over (order by i desc)), 6) as q from r")
def by(spark, sf):
    p = frames.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.exp(-F.abs(F.avg("l_discount") - 0.05) * 400).alias("p"))
    return rounded(scoring.fdr(p, "p", dependent=True).select("k", "q"))


@query("inf04_05_step_down", ssql.step_down(RETURNS, 400))
def step_down(spark, sf):
    """Mean returns by weekday against rotations of each symbol's series: step-down p-values."""
    r = returns(spark, sf).where("r is not null").select("symbol", "day", "r", F.dayofweek("day").alias("dow"))

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        x, dow = pdf["r"].to_numpy(), pdf["dow"].to_numpy()
        stat = lambda v: np.array([abs(v[dow == k].mean()) / (v[dow == k].std() / np.sqrt((dow == k).sum())) for k in range(1, 8)])
        shifts = 30 + np.floor(hashed.uniforms("1", 400) * (len(x) - 60)).astype(int)
        null = np.stack([stat(np.roll(x, s)) for s in shifts])
        p = scoring.step_down(stat(x), null)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "dow": np.arange(1, 8), "p": p})

    return rounded(r.groupBy("symbol").applyInPandas(f, "symbol string, dow int, p double"))


@query("inf12_sharpe", RETURNS + """, m as (select symbol, avg(r) / stddev_samp(r) as s, (avg(r ** 3) - 3 * avg(r) * avg(r ** 2) + 2 * avg(r) ** 3) / stddev_pop(r) ** 3 as g, kurtosis_pop(r) as k, count(r) as n from ret group by 1) select symbol, round(s, 6) as sharpe, round(sqrt((1 - g * s + (k + 2) / 4 * s * s) / (n - 1)), 6) as spread from m""")
def sharpe(spark, sf):
    return rounded(returns(spark, sf).groupBy("symbol").agg(*scoring.sharpe_parts("r")))


@query("inf13_overfitting", ssql.overfitting(RETURNS))
def overfitting(spark, sf):
    r = returns(spark, sf).where("r is not null")
    block = F.ntile(8).over(Window.partitionBy("symbol").orderBy("day"))
    rows = r.withColumn("block", block)
    for k in range(1, 7):
        rows = rows.withColumn(f"s{k}", F.signum(F.lag("r", k).over(ind.w())) * F.col("r"))
    g = rows.groupBy("block").agg(*[F.avg(f"s{k}").alias(f"s{k}") for k in range(1, 7)]).orderBy("block").toPandas()  # eight rows
    return rounded(spark.createDataFrame([(float(scoring.overfitting(g[[f"s{k}" for k in range(1, 7)]].to_numpy())),)], "pbo double"))


@query("inf16_yearly_card", P3 + ", c as (select avg((y = 1)::integer) as c from p where day < date '1999-10-13') select year(day)::integer as year, count(*) as n, round(1 - avg((p1 - (y = 1)::integer) ** 2) / avg((c - (y = 1)::integer) ** 2), 6) as skill from p, c group by 1 having count(*) >= 200")
def yearly_card(spark, sf):
    p = three_class(spark, sf)
    hit = (F.col("y") == 1).cast("double")
    c = p.where(F.col("day") < F.lit("1999-10-13").cast("date")).agg(F.avg(hit).alias("c"))
    rows = p.crossJoin(F.broadcast(c))  # one row
    g = rows.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), scoring.skill(F.pow(F.col("p1") - hit, F.lit(2)), F.pow(F.col("c") - hit, F.lit(2))).alias("skill"))
    return rounded(g.where("n >= 200"))


@query("inf17_event_bootstrap", RETURNS + f", {frames.CALENDAR}, rows_ as (select symbol, abs(r) as s, row_number() over (partition by symbol order by day) - 1 as i, count(*) over (partition by symbol) as n from ret where r is not null and day in (select day from calendar)), " + ssql.bootstrapped("rows_", "s", "quantile_cont({}, 0.5)", 300, 1))
def event_bootstrap(spark, sf):
    c = frames.calendar(spark, sf).select("day").distinct()
    r = returns(spark, sf).where("r is not null").join(c, "day", "left_semi").select("symbol", "day", F.abs("r").alias("size"))
    return rounded(scoring.interval(scoring.bootstrap(r, ["size"], np.median, 300, 1)))
