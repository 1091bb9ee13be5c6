"""Lead-lag relations, effects under confounding and pooled coefficients."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import hashed
from marketloom.operators import bars, causal
from marketloom.operators import indicators as ind
from marketloom.plans import series_sql as ssql
from marketloom.plans.catalog import query, rounded
from marketloom.plans.forecast_queries import LV, log_variance
from marketloom.plans.relational_queries import RETURNS, returns
from marketloom.sources import frames

OWN, OTHER = ["y1", "y2", "y3"], ["x1", "x2", "x3"]


def lagged_pairs(spark, sf):
    """cause, effect, day, y and three lags of both, over the days that both have."""
    r = returns(spark, sf).where("r is not null")
    effect = r.select("day", F.col("symbol").alias("effect"), F.col("r").alias("y"))
    rows = r.select("day", F.col("symbol").alias("cause"), F.col("r").alias("x")).join(effect, "day").where("cause <> effect")  # a day has few symbols
    w = Window.partitionBy("cause", "effect").orderBy("day")
    return rows.withColumns({f"{v}{k}": F.lag(v, k).over(w) for v in "yx" for k in (1, 2, 3)})


@query("inf09_hac_wald", ssql.hac_wald(RETURNS))
def hac_wald(spark, sf):
    """Do the lags of one symbol say nothing about another, whatever the errors' variance and correlation?"""
    rows = lagged_pairs(spark, sf)
    return rounded(causal.hac_wald(rows, ["cause", "effect"], "day", OWN + OTHER, "y", OTHER), 5, wald=4)


@query("inf10_lagged_links")
def lagged_links(spark, sf):
    """Which order priorities' returns lead which; without SQL, tests hold it against regressions over all subsets."""
    r = bars.estimators(frames.other_daily(spark, sf)).select("symbol", "day", F.col("r_cc").alias("r"))
    return rounded(causal.lagged_links(r, lags=2), 6)


DML = LV + f""", f as (select symbol, day, lv, lw, lm, y, floor(5 * {hashed.half_sql("md5('fold|' || symbol || '|' || day)")})::integer as fold from h where lw is not null and lm is not null and y is not null)"""


def folded(spark, sf):
    v = log_variance(spark, sf).where("lw is not null and lm is not null and y is not null").select("symbol", "day", "lv", "lw", "lm", "y")
    return v.withColumn("fold", F.floor(5 * hashed.half(hashed.digest(F.lit("fold"), F.col("symbol"), F.col("day")))).cast("int"))


@query("inf11_double_regression", ssql.partialled_out(DML))
def double_regression(spark, sf):
    """Effect of today's log variance on tomorrow's, given the week and the month."""
    return rounded(causal.partialled_out(folded(spark, sf), ["symbol"], "y", "lv", ["lw", "lm"], "fold"), 5, t=4)


HARQ = ["lv", "lw", "lm", "lqv"]
HARQ_SQL = LV + """, g as (select *, lag(lv) over (partition by symbol order by day) * lv as lqv from h), harq as (select * from g where lw is not null and lm is not null and lqv is not null and y is not null and day < date '1999-10-13')"""


@query("inf16_poolability_all", ssql.poolability(HARQ_SQL, HARQ))
def poolability_all(spark, sf):
    """Chow's F that all coefficients (day, week, month, an interaction) are the same for all symbols, in training."""
    v = log_variance(spark, sf).withColumn("lqv", F.lag("lv").over(ind.w()) * F.col("lv")).where(F.col("day") < F.lit("1999-10-13").cast("date"))
    return rounded(causal.poolability(v, "symbol", HARQ, "y"), 5, f=4).drop("p")
