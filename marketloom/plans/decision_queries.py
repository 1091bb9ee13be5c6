"""Chances of touching a stop, and what usually follows the last states, in words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import special
from marketloom.operators import aggregates
from marketloom.operators import indicators as ind
from marketloom.plans import series_sql as ssql
from marketloom.plans.catalog import query, rounded
from marketloom.plans.forecast_queries import LV, log_variance
from marketloom.plans.relational_queries import RETURNS, returns

STOPS, SPANS = (0.5, 1.0, 1.5, 2.0), (1, 5, 10)
TRAIN = "day < date '1999-10-13'"
LOWEST = ", ".join(f"case when len(x{h}) = {h} then list_min(list_transform(range(1, {h + 1}), lambda i: list_sum(x{h}[1:i]))) end as low{h}" for h in SPANS)
PATHS = RETURNS + f""", s as (select symbol, day, r, case when count(r) over w = 60 then stddev_pop(r) over w end as sigma from ret window w as (partition by symbol order by day rows between 60 preceding and 1 preceding)),
  z as (select symbol, day, r / sigma as z from s where sigma > 0 and r is not null and {TRAIN}), x as (select *, {', '.join(f'list(z) over (partition by symbol order by day rows between current row and {h - 1} following) as x{h}' for h in SPANS)} from z),
  p as (select symbol, {LOWEST} from x), m as (select symbol, case when kurtosis_pop(z) > 0 then least(greatest(4 + 6 / kurtosis_pop(z), 2.5), 40) else 40 end as nu, stddev_pop(z) as sd from z group by 1),
  f as (select *, sd * sqrt((nu - 2) / nu) as scale from m)"""


@query(
    "dec01_reflection",
    PATHS + " select * from (" + " union all ".join(
        f"select p.symbol, {k!r}::double as stop, {h}::integer as horizon, count(low{h}) as n, round(avg((low{h} <= -{k!r}::double)::integer), 6) as touched, round(any_value(least(1, {ssql.beta_tail(f'({k * k!r} / (scale * scale * {h}) / (nu + {k * k!r} / (scale * scale * {h})))', '(nu / 2)', '0.5::double')})), 6) as reflected, round(any_value(nu), 6) as nu from p join f using (symbol) group by p.symbol"
        for k in STOPS for h in SPANS
    ) + ")",
)
def reflection(spark, sf):
    """The chance to touch a stop k deviations away within some rows: by
    reflection, twice Student's chance to end beyond it, and as it was in training."""
    before = ind.w().rowsBetween(-60, -1)
    rows = returns(spark, sf).withColumn("sigma", F.when(F.count("r").over(before) == 60, F.stddev_pop("r").over(before)))
    rows = rows.where("sigma > 0 and r is not null").where(F.col("day") < F.lit("1999-10-13").cast("date")).select("symbol", "day", (F.col("r") / F.col("sigma")).alias("z"))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(float("inf")).alias("low"))
    step = lambda a, v: F.struct((a["at"] + v).alias("at"), F.least(a["low"], a["at"] + v).alias("low"))
    path = lambda h: F.collect_list("z").over(ind.w().rowsBetween(0, h - 1))
    lows = rows.withColumns({f"x{h}": path(h) for h in SPANS}).select("symbol", "z", *[F.when(F.size(f"x{h}") == h, F.aggregate(f"x{h}", start, step)["low"]).alias(f"low{h}") for h in SPANS])
    touched = [F.struct(F.lit(k).alias("stop"), F.lit(h).alias("horizon"), F.count(f"low{h}").alias("n"), F.avg((F.col(f"low{h}") <= -k).cast("double")).alias("touched")) for k in STOPS for h in SPANS]
    g = lows.groupBy("symbol").agg(F.kurtosis("z").alias("kurtosis"), F.stddev_pop("z").alias("sd"), F.array(*touched).alias("t"))
    nu = F.when(F.col("kurtosis") > 0, F.least(F.greatest(4 + 6 / F.col("kurtosis"), F.lit(2.5)), F.lit(40.0))).otherwise(40.0)
    g = g.withColumn("nu", nu).withColumn("scale", F.col("sd") * F.sqrt((F.col("nu") - 2) / F.col("nu"))).select("symbol", "nu", "scale", F.explode("t").alias("t")).select("symbol", "nu", "scale", "t.*")

    @F.pandas_udf("double")
    def below(x: pd.Series, nu: pd.Series) -> pd.Series:
        return pd.Series([float(special.t_cdf(-a, b)) for a, b in zip(x, nu, strict=True)])

    end = below(F.col("stop") / (F.col("scale") * F.sqrt(F.col("horizon").cast("double"))), F.col("nu"))
    return rounded(g.select("symbol", "stop", "horizon", "n", "touched", F.least(F.lit(1.0), 2 * end).alias("reflected"), "nu"))


NAMES = ("low", "middle", "high")
WORD = lambda c: f"case {c} when 0 then 'low' when 1 then 'middle' else 'high' end"
STATES = LV + f""", q as (select symbol, quantile_cont(lv, [1 / 3::double, 2 / 3::double]) as q from v where {TRAIN} group by 1), s as (select v.symbol, day, len(list_filter(q, lambda e: e <= lv))::integer as s from v join q using (symbol)),
  l as (select symbol, day, s, lag(s) over w as s1, lag(s, 2) over w as s2, lead(s) over w as nxt from s window w as (partition by symbol order by day)), t as (select * from l where s2 is not null),
  n as (select s2, s1, s, nxt, count(*) as hits, sum(count(*)) over (partition by s2, s1, s) as n from t where nxt is not null and {TRAIN} group by 1, 2, 3, 4), b as (select nxt, count(*) / sum(count(*)) over () as base from t where nxt is not null and {TRAIN} group by 1),
  f as (select n.*, hits / n / base as lift from n join b using (nxt) where n >= 30), k as (select *, row_number() over (partition by s2, s1, s order by lift desc, nxt) as i from f),
  d as (select symbol, max(day) as day from t group by 1)"""


@query("dec03_transition_rule", STATES + f""" select t.symbol, t.day, n::bigint as n, round(lift, 6) as lift, {WORD('t.s2')} || ' > ' || {WORD('t.s1')} || ' > ' || {WORD('t.s')} as states, case when lift is not null then {WORD('k.nxt')} end as usual,
  case when lift is not null then 'After ' || {WORD('t.s2')} || ' > ' || {WORD('t.s1')} || ' > ' || {WORD('t.s')} || ', ' || {WORD('k.nxt')} || ' variance follows ' || printf('%.2f', lift) || ' times as often as at large.' else 'No rule for ' || {WORD('t.s2')} || ' > ' || {WORD('t.s1')} || ' > ' || {WORD('t.s')} || '.' end as rule
  from t join d on d.symbol = t.symbol and d.day = t.day left join k on k.s2 = t.s2 and k.s1 = t.s1 and k.s = t.s and i = 1""")
def transition_rule(spark, sf):
    """The last three states of each symbol's variance, and which state followed
    them in training more often than at large, as a sentence."""
    v = log_variance(spark, sf).select("symbol", "day", "lv")
    train = F.col("day") < F.lit("1999-10-13").cast("date")
    q = v.where(train).groupBy("symbol").agg(F.percentile("lv", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    rows = v.join(F.broadcast(q), "symbol").withColumn("s", aggregates.digitize(F.col("lv"), F.col("q")))  # a row per symbol
    w = ind.w()
    rows = rows.select("symbol", "day", F.lag("s", 2).over(w).alias("s2"), F.lag("s").over(w).alias("s1"), "s", F.lead("s").over(w).alias("next")).where("s2 is not null")
    states = ["s2", "s1", "s"]
    seen = rows.where(train & F.col("next").isNotNull())
    base = seen.groupBy("next").agg(F.count(F.lit(1)).alias("c")).withColumn("base", F.col("c") / F.sum("c").over(Window.partitionBy()))  # three states
    hits = seen.groupBy(*states, "next").agg(F.count(F.lit(1)).alias("hits")).withColumn("n", F.sum("hits").over(Window.partitionBy(*states)))
    lifts = hits.where("n >= 30").join(F.broadcast(base), "next").withColumn("lift", F.col("hits") / F.col("n") / F.col("base"))
    best = lifts.withColumn("i", F.row_number().over(Window.partitionBy(*states).orderBy(F.col("lift").desc(), "next"))).where("i = 1").select(*states, "n", "lift", F.col("next").alias("to"))
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("day", *states), "day").alias("x")).select("symbol", "x.*")
    name = lambda c: F.element_at(F.array(*map(F.lit, NAMES)), F.col(c).cast("int") + 1)
    path = F.concat_ws(" > ", *map(name, states))
    rule = F.concat(F.lit("After "), path, F.lit(", "), name("to"), F.lit(" variance follows "), F.format_string("%.2f", "lift"), F.lit(" times as often as at large."))
    found = last.join(F.broadcast(best), states, "left")  # 27 patterns at most
    return rounded(found.select("symbol", "day", "n", "lift", path.alias("states"), name("to").alias("usual"), F.when(F.col("lift").isNotNull(), rule).otherwise(F.concat(F.lit("No rule for "), path, F.lit("."))).alias("rule")))
