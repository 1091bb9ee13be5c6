"""Fitted tails, tails over all rows so far, and shifts of distribution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import hashed
from marketloom.operators import extremes, scoring
from marketloom.operators import indicators as ind
from marketloom.plans import series_sql as ssql
from marketloom.plans.catalog import query, rounded
from marketloom.plans.relational_queries import RETURNS, returns

CUT = "date '1999-10-13'"
ROWS = RETURNS + ", z as (select symbol, day, r from ret where r is not null)"


def known(spark, sf):
    return returns(spark, sf).where("r is not null").select("symbol", "day", "r")


def before():
    return F.col("day") < F.lit("1999-10-13").cast("date")


@query(
    "var06_static_expanding",
    ROWS + f""", i as (select *, row_number() over (partition by symbol order by day) - 1 as k from z), p as (select *, case when k >= 250 then (k - 250) // 21 + 1 else 0 end as block from i),
    e as (select b.symbol, b.block, quantile_cont(p.r, 0.05) as q from (select distinct symbol, block from p where block > 0) b join p on p.symbol = b.symbol and p.block < b.block group by 1, 2),
    t as (select e.symbol, e.block, any_value(q) as q, avg(p.r) as tail from e join p on p.symbol = e.symbol and p.block < e.block and p.r <= e.q group by 1, 2),
    s0 as (select symbol, quantile_cont(r, 0.05) as q from z where day < {CUT} group by 1), s as (select s0.symbol, any_value(q) as q, avg(r) as tail from s0 join z on z.symbol = s0.symbol and z.day < {CUT} and z.r <= s0.q group by 1)
    select p.symbol, day, round(r, 6) as r, round(t.q, 6) as q, round(t.tail, 6) as tail, round(s.q, 6) as static_q, round(s.tail, 6) as static_tail from p left join t on t.symbol = p.symbol and t.block = p.block join s on s.symbol = p.symbol""",
)
def static_expanding(spark, sf):
    """5 % quantiles and tail means: of training, and of all rows before each block of 21."""
    rows = known(spark, sf)
    q = rows.where(before()).groupBy("symbol").agg(F.percentile("r", F.lit(0.05)).alias("static_q"))
    tail = rows.where(before()).join(q, "symbol").where("r <= static_q").groupBy("symbol").agg(F.first("static_q").alias("static_q"), F.avg("r").alias("static_tail"))
    return rounded(extremes.expanding_tails(rows, "r", 0.05).join(tail, "symbol"))


LOSS = ROWS + """, a as (select symbol, day, -r as loss, {weight} as w from z)"""
AGED = "exp(-(row_number() over (partition by symbol order by day desc) - 1) / 250::double)"


def losses(spark, sf, aged: bool):
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("day").desc())) - 1
    return known(spark, sf).select("symbol", "day", (-F.col("r")).alias("loss"), (F.exp(-age / 250.0) if aged else F.lit(1.0)).alias("w"))


@query("var10_pareto_likelihood", ssql.peaks_over_threshold(LOSS.format(weight="1.0::double")))
def pareto_likelihood(spark, sf):
    """Generalised Pareto law of losses beyond their 90 % quantile, by likelihood; the 99 % loss and the mean beyond it."""
    return rounded(extremes.peaks_over_threshold(losses(spark, sf, False), "symbol", "loss", "w", "day"), 5)


@query("var12_weighted_pareto", ssql.peaks_over_threshold(LOSS.format(weight=AGED)))
def weighted_pareto(spark, sf):
    """The same with weights that fade with age."""
    return rounded(extremes.peaks_over_threshold(losses(spark, sf, True), "symbol", "loss", "w", "day"), 5)


FEATURES = ["r", "size", "level", "beyond"]
SHIFT = ROWS + f""", sd as (select symbol, stddev_pop(r) as sd from z where day < {CUT} group by 1),
  f as (select z.symbol, day, r, abs(r) as size, case when count(r) over w = 20 then avg(abs(r)) over w end as level, case when count(r) over w = 20 then avg((abs(r) > 1.5 * sd)::integer) over w end as beyond, (day >= {CUT})::integer as after,
    floor(5 * {hashed.half_sql("md5('shift|' || z.symbol || '|' || day)")})::integer as fold from z join sd on sd.symbol = z.symbol window w as (partition by z.symbol order by day rows between 19 preceding and current row)),
  x as (select * from f where level is not null and beyond is not null)"""


def shifted(spark, sf):
    rows = known(spark, sf)
    sd = rows.where(before()).groupBy("symbol").agg(F.stddev_pop("r").alias("sd"))
    rows = rows.join(sd, "symbol").withColumns({"size": F.abs("r"), "wide": (F.abs("r") > 1.5 * F.col("sd")).cast("double"), "after": (~before()).cast("int")})
    fold = F.floor(5 * hashed.half(hashed.digest(F.lit("shift"), F.col("symbol"), F.col("day")))).cast("int")
    return rows.withColumns({"level": ind.full(F.avg, "size", 20), "beyond": ind.full(F.avg, "wide", 20), "fold": fold}).select("symbol", "day", *FEATURES, "after", "fold")


@query("var12_distribution_shift", ssql.distribution_shift(SHIFT, FEATURES))
def distribution_shift(spark, sf):
    """Can rows of the test span be told from those before?  And the sizes' 95 %
    quantile before, weighted by how likely each row would be after."""
    scored = extremes.shift_scores(shifted(spark, sf), "symbol", "after", FEATURES, "fold")
    q = scoring.weighted_quantile(scored.where("after = 0"), "size", "ratio", 0.95, "symbol", "day").select("symbol", F.col("q95").alias("reweighted"), F.col("plain").alias("q_before"))
    later = scored.where("after = 1").groupBy("symbol").agg(F.percentile("size", F.lit(0.95)).alias("q_after"))
    return rounded(extremes.shift_test(scored, "symbol", "after").join(q, "symbol").join(later, "symbol"), 5)
