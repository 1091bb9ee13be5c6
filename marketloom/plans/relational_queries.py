"""Joins, set operations, sorting, aggregation and pivots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import aggregates, bars, joins, neighbours
from marketloom.plans.catalog import query, rounded
from marketloom.sources import frames

D = f"with {frames.DAILY}"
RETURNS = D + ", ret as (select symbol, day, close, n_bars, ln(close) - ln(lag(close) over (partition by symbol order by day)) as r from daily)"


def returns(spark, sf):
    return bars.estimators(frames.daily(spark, sf)).select("symbol", "day", "close", "n_bars", F.col("r_cc").alias("r"))


@query("jn01_inner_join", f"{D}, {frames.OTHER_DAILY} select a.symbol, b.symbol as other, day, a.close, b.close as other_close from daily a join other_daily b using (day)")
def inner_join(spark, sf):
    o = frames.other_daily(spark, sf).select("day", F.col("symbol").alias("other"), F.col("close").alias("other_close"))
    return frames.daily(spark, sf).select("symbol", "day", "close").join(o, "day").select("symbol", "other", "day", "close", "other_close")


@query("jn02_04_keyed_join", "select o_orderkey, l_linenumber, c_custkey, o_totalprice from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where c_mktsegment = 'HOUSEHOLD'")
def keyed_join(spark, sf):
    li, o, c = (frames.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    c = c.where("c_mktsegment = 'HOUSEHOLD'")
    return li.select("l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "l_linenumber", "c_custkey", "o_totalprice")


@query("jn03_left_join", f"{D}, {frames.CALENDAR} select symbol, day, code from daily left join calendar using (day)")
def left_join(spark, sf):
    return frames.daily(spark, sf).select("symbol", "day").join(frames.calendar(spark, sf), "day", "left").select("symbol", "day", "code")


@query("jn05_self_overlap", RETURNS + " select x.symbol as a, y.symbol as b, day, round(x.r - y.r, 6) as gap from ret x join ret y using (day) where x.symbol < y.symbol and x.r is not null and y.r is not null")
def self_overlap(spark, sf):
    r = returns(spark, sf).where("r is not null")
    x, y = (r.select("day", F.col("symbol").alias(n), F.col("r").alias(f"r{n}")) for n in "ab")
    return rounded(x.join(y, "day").where("a < b").select("a", "b", "day", (F.col("ra") - F.col("rb")).alias("gap")))


FLAGGED = "x as (select o_orderpriority as symbol, o_orderdate::date as day, max(o_totalprice) as level from orders where o_totalprice >= 450000 group by 1, 2)"


def _levels(spark, sf):
    o = frames.table(spark, sf, "orders").where("o_totalprice >= 450000")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("level"))


@query("jn06_07_asof_backward", f"with {frames.OTHER_DAILY}, {FLAGGED} select o.symbol, o.day, o.close, x.level from other_daily o asof left join x on o.symbol = x.symbol and o.day >= x.day")
def asof_backward(spark, sf):
    return joins.asof(frames.other_daily(spark, sf).select("symbol", "day", "close"), _levels(spark, sf), "day", "level")


@query("jn06_asof_strict", f"with {frames.OTHER_DAILY}, {FLAGGED} select o.symbol, o.day, x.level from other_daily o asof left join x on o.symbol = x.symbol and o.day > x.day")
def asof_strict(spark, sf):
    return joins.asof(frames.other_daily(spark, sf).select("symbol", "day"), _levels(spark, sf), "day", "level", strict=True)


@query("jn17_asof_lagged", f"with {frames.OTHER_DAILY}, {FLAGGED}, y as (select symbol, day, lag(level) over (partition by symbol order by day) as level from x) select o.symbol, o.day, y.level from other_daily o asof left join y on o.symbol = y.symbol and o.day >= y.day")
def asof_lagged(spark, sf):
    return joins.asof(frames.other_daily(spark, sf).select("symbol", "day"), _levels(spark, sf), "day", "level", lag=1)


GRID = f"with {frames.OTHER_DAILY}, g as (select symbol, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from other_daily group by 1), f as (select g.symbol, g.day, close from g left join other_daily o using (symbol, day))"


@query("jn08_fill_with_limit", GRID + " select symbol, day, close, last_value(close ignore nulls) over (partition by symbol order by day rows between 2 preceding and current row) as close_filled from f")
def fill_limit(spark, sf):
    d = joins.densify(frames.other_daily(spark, sf).select("symbol", "day", "close"))
    return joins.forward_fill(d, "close", 2)


@query("jn09_next_session", f"{D}, s as (select distinct day from daily), e as (select distinct o_orderdate::date as day from orders) select e.day, min(s.day) as next_session from e left join s on s.day > e.day group by 1")
def next_session(spark, sf):
    e = frames.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return joins.next_after(e, frames.daily(spark, sf).select("day"))


@query(
    "jn10_sessions_after_event",
    f"""{D}, {frames.CALENDAR}, s as (select day, row_number() over (order by day) as place from (select distinct day from daily)), e as (select distinct c.day as event_day, (select min(place) from s where s.day > c.day) as place from calendar c)
    select s.day, max(event_day) as event_day from s join e on s.place between e.place and e.place + 2 group by 1""",
)
def sessions_after(spark, sf):
    return joins.sessions_after(frames.calendar(spark, sf).select("day"), frames.daily(spark, sf).select("day"), 3)


@query("jn12_semi_join", f"{D}, {frames.CALENDAR} select symbol, day, close from daily where day in (select day from calendar)")
def semi(spark, sf):
    return frames.daily(spark, sf).select("symbol", "day", "close").join(frames.calendar(spark, sf), "day", "left_semi").select("symbol", "day", "close")


@query("jn13_anti_join", f"{D}, {frames.CALENDAR} select symbol, day, close from daily where day not in (select day from calendar)")
def anti(spark, sf):
    return frames.daily(spark, sf).select("symbol", "day", "close").join(frames.calendar(spark, sf), "day", "left_anti").select("symbol", "day", "close")


@query("jn14_calendar_range", f"{D}, {frames.CALENDAR} select symbol, d.day, count(c.day) as near from daily d left join calendar c on c.day between d.day - 3 and d.day + 3 group by 1, 2")
def calendar_range(spark, sf):
    c = frames.calendar(spark, sf).select(F.explode(F.sequence(F.date_sub("day", 3), F.date_add("day", 3))).alias("day"), F.lit(1).alias("hit"))
    return frames.daily(spark, sf).select("symbol", "day").join(c, "day", "left").groupBy("symbol", "day").agg(F.count("hit").alias("near"))


@query("jn15_month_with_lag", f"{D}, {frames.MONTHLY_RATE} select symbol, day, cur, round(rate, 4) as rate from daily left join monthly_rate on cast(month + interval 2 month as date) = date_trunc('month', day)::date")
def month_lag(spark, sf):
    d = frames.daily(spark, sf).select("symbol", "day")
    return rounded(joins.with_month_lag(d, frames.monthly_rate(spark, sf), 2).select("symbol", "day", "cur", "rate"), 4)


@query("jn16_common_grid", f"with {frames.OTHER_DAILY} select symbol, day, close from other_daily where day in (select day from other_daily group by day having count(distinct symbol) = 5)")
def common_grid(spark, sf):
    return joins.common_days(frames.other_daily(spark, sf)).select("symbol", "day", "close")


@query("jn18_cross_with_grid", f"{D} select symbol, d::double as distance, count(*) filter (low <= open * (1 - d)) as hits from daily, (values (0.1), (0.3), (0.5)) v(d) group by 1, 2")
def cross_grid(spark, sf):
    g = spark.createDataFrame([(0.1,), (0.3,), (0.5,)], "distance double")
    return frames.daily(spark, sf).crossJoin(F.broadcast(g)).groupBy("symbol", "distance").agg(F.count_if(F.col("low") <= F.col("open") * (1 - F.col("distance"))).alias("hits"))


@query("bitemporal_known_at", "select o_orderpriority as code, o_custkey % 10 as period, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as value from orders where o_orderdate <= timestamp '1998-06-30' group by 1, 2")
def known_at(spark, sf):
    o = frames.table(spark, sf, "orders").where(F.col("o_orderdate") <= F.lit("1998-06-30").cast("timestamp_ntz"))
    return o.groupBy(F.col("o_orderpriority").alias("code"), (F.col("o_custkey") % 10).alias("period")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("value"))


@query("set01_union_all", f"{D}, {frames.OTHER_DAILY} select symbol, day, close from daily union all select symbol, day, close from other_daily")
def union_all(spark, sf):
    return frames.daily(spark, sf).select("symbol", "day", "close").unionByName(frames.other_daily(spark, sf).select("symbol", "day", "close"))


@query("set02_priority_union", f"{D}, a as (select day, close from daily where symbol = 'A' and isodow(day) <> 3), b as (select day, close from daily where symbol = 'R') select day, close, 'live' as source from a union all select day, close, 'backup' from b where day not in (select day from a)")
def priority_union(spark, sf):
    d = frames.daily(spark, sf)
    a = d.where("symbol = 'A' and dayofweek(day) <> 4").select("day", "close")
    return joins.priority_union(a, d.where("symbol = 'R'").select("day", "close"), ["day"], ("live", "backup"))


@query("set03_splice", f"{D}, h as (select symbol, day, close from daily where day < date '1999-01-01'), l as (select symbol, day, open as close from daily where day >= date '1998-12-01') select * from h union all select * from l where (symbol, day) not in (select symbol, day from h)")
def splice(spark, sf):
    d = frames.daily(spark, sf)
    return joins.splice(d.where("day < date '1999-01-01'").select("symbol", "day", "close"), d.where("day >= date '1998-12-01'").select("symbol", "day", F.col("open").alias("close")), ["symbol", "day"])


@query("set04_intersect", f"{D}, {frames.OTHER_DAILY} select day from daily intersect select day from other_daily")
def intersect(spark, sf):
    return frames.daily(spark, sf).select("day").intersect(frames.other_daily(spark, sf).select("day"))


@query("set05_dense_grid", GRID + " select symbol, day, close from f")
def dense(spark, sf):
    return joins.densify(frames.other_daily(spark, sf).select("symbol", "day", "close"))


@query("set06_except", f"{D}, {frames.CALENDAR} select day from daily except select day from calendar")
def except_(spark, sf):
    return frames.daily(spark, sf).select("day").subtract(frames.calendar(spark, sf).select("day"))


@query("set07_distinct_first", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) where k = 1")
def distinct_first(spark, sf):
    o = frames.table(spark, sf, "orders")
    first = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return o.groupBy("o_custkey").agg(first.alias("x")).select("o_custkey", "x.o_orderkey", "x.o_totalprice")


@query("srt01_02_top_k", f"{D} select symbol, day, (high - low) / close as size from daily order by size desc, symbol, day limit 25")
def top_k(spark, sf):
    return frames.daily(spark, sf).select("symbol", "day", ((F.col("high") - F.col("low")) / F.col("close")).alias("size")).orderBy(F.col("size").desc(), "symbol", "day").limit(25)


@query("srt02_bottom_k_per_symbol", f"{D} select symbol, day, close from (select *, row_number() over (partition by symbol order by close, day) as k from daily) where k <= 5")
def bottom_k(spark, sf):
    k = F.row_number().over(Window.partitionBy("symbol").orderBy("close", "day"))
    return frames.daily(spark, sf).withColumn("k", k).where("k <= 5").select("symbol", "day", "close")


@query("srt03_last_n", f"{D} select symbol, day, close from (select *, row_number() over (partition by symbol order by day desc) as k from daily) where k <= 30")
def last_n(spark, sf):
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("day").desc()))
    return frames.daily(spark, sf).withColumn("k", k).where("k <= 30").select("symbol", "day", "close")


@query(
    "srt04_nearest_neighbours",
    """with q as (select * from embeddings where vec_id % 50 = 0), d as (select q.vec_id as query_id, e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::double - z[2]::double) ** 2)), 6) as dist from q, embeddings e where e.vec_id <> q.vec_id)
    select query_id, vec_id, dist from (select *, row_number() over (partition by query_id order by dist, vec_id) as k from d) where k <= 5""",
)
def nearest(spark, sf):
    e = frames.table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))
    return neighbours.nearest(e, q)


@query("srt05_argmax_and_mode", "select o_orderpriority as symbol, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as largest, arg_max(o_orderstatus, (n, o_orderstatus)) as usual from orders join (select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2) using (o_orderpriority, o_orderstatus) group by 1")
def argmax(spark, sf):
    o = frames.table(spark, sf, "orders")
    a = o.groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("largest"))
    n = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("o_orderpriority").agg(F.max_by("o_orderstatus", F.struct("n", "o_orderstatus")).alias("usual"))
    return a.join(m, "o_orderpriority").select(F.col("o_orderpriority").alias("symbol"), "largest", "usual")


@query("agg01_quantile_table", "select l_returnflag as symbol, l_linestatus as status, quantile_cont(l_extendedprice, 0.5) as med, round(quantile_cont(l_extendedprice, 0.95), 4) as p95, round(quantile_cont(l_extendedprice, 0.99), 4) as p99, count(*) as n from lineitem group by 1, 2")
def quantile_table(spark, sf):
    q = F.percentile("l_extendedprice", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    t = frames.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("status")).agg(q.alias("q"), F.count(F.lit(1)).alias("n"))
    return t.select("symbol", "status", F.col("q")[0].alias("med"), F.round(F.col("q")[1], 4).alias("p95"), F.round(F.col("q")[2], 4).alias("p99"), "n")


@query("agg02_mean_min", "select l_suppkey, round(avg(l_discount), 6) as mean_discount, min(l_extendedprice) as least from lineitem group by 1")
def mean_min(spark, sf):
    return rounded(frames.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("mean_discount"), F.min("l_extendedprice").alias("least")))


@query("agg03_sorted_unique_list", f"with {frames.CALENDAR} select day, string_agg(code, ',' order by code) as codes from calendar group by 1")
def unique_list(spark, sf):
    return frames.calendar(spark, sf).groupBy("day").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))


@query("agg04_pivot", f"{D} select year(day)::integer as year, round(avg(close) filter (symbol = 'A'), 6) as \"A\", round(avg(close) filter (symbol = 'N'), 6) as \"N\", round(avg(close) filter (symbol = 'R'), 6) as \"R\" from daily group by 1")
def pivot(spark, sf):
    return rounded(frames.daily(spark, sf).groupBy(F.year("day").alias("year")).pivot("symbol", ["A", "N", "R"]).agg(F.avg("close")))


@query("agg05_month_last", f"with {frames.OTHER_DAILY} select symbol, date_trunc('month', day)::date as month, arg_max(close, day) as last_close from other_daily group by 1, 2")
def month_last(spark, sf):
    return frames.other_daily(spark, sf).groupBy("symbol", F.trunc("day", "month").alias("month")).agg(F.max_by("close", "day").alias("last_close"))


@query("agg06_equal_weight", RETURNS + " select day, round(avg(r), 6) as r, count(r) as n from ret group by 1")
def equal_weight(spark, sf):
    return rounded(returns(spark, sf).groupBy("day").agg(F.avg("r").alias("r"), F.count("r").alias("n")))


@query("agg07_correlations", RETURNS + " select x.symbol as a, y.symbol as b, round(corr(x.r, y.r), 6) as corr, count(*) as n from ret x join ret y using (day) where x.symbol < y.symbol and x.r is not null and y.r is not null group by 1, 2")
def correlations(spark, sf):
    return rounded(aggregates.correlation_matrix(returns(spark, sf).where("r is not null"), "r"))


EDGES = RETURNS + ", e as (select symbol, quantile_cont(r, 0.3333) as e1, quantile_cont(r, 0.6667) as e2 from ret where day < date '1999-10-13' group by 1)"


@query("agg08_train_thresholds", EDGES + " select symbol, round(e1, 6) as e1, round(e2, 6) as e2 from e")
def thresholds(spark, sf):
    e = aggregates.edges(returns(spark, sf).where("day < date '1999-10-13'"), "r", (0.3333, 0.6667))
    return rounded(e.select("symbol", F.col("edges")[0].alias("e1"), F.col("edges")[1].alias("e2")))


BINS = EDGES + ", b as (select symbol, day, r, case when r >= e2 then 2 when r >= e1 then 1 when r is not null then 0 end as bin from ret join e using (symbol))"


def binned(spark, sf):
    r = returns(spark, sf)
    e = aggregates.edges(r.where("day < date '1999-10-13'"), "r", (0.3333, 0.6667))
    return r.join(F.broadcast(e), "symbol").withColumn("bin", aggregates.digitize(F.col("r"), F.col("edges"))).drop("edges")  # a row per symbol


@query("agg09_digitize", BINS + " select symbol, day, bin from b")
def digitize(spark, sf):
    return binned(spark, sf).select("symbol", "day", "bin")


@query("agg10_11_class_counts", BINS + " select symbol, bin, count(*) as n, count(distinct year(day)) as years from b where bin is not null group by 1, 2")
def class_counts(spark, sf):
    return binned(spark, sf).where("bin is not null").groupBy("symbol", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.year("day")).alias("years"))


@query("agg12_transitions", BINS + ", t as (select symbol, lag(bin) over (partition by symbol order by day) as prev, bin as cur from b), n as (select symbol, prev, cur, count(*) as n from t where prev is not null and cur is not null group by 1, 2, 3) select symbol, prev, cur, n, round((n + 1.0::double) / (sum(n) over (partition by symbol, prev) + 3), 6) as p from n")
def transitions(spark, sf):
    return rounded(aggregates.transitions(binned(spark, sf), "bin"))


@query("agg13_moments", RETURNS + " select symbol, round(avg(r), 6) as mean, round(stddev_samp(r), 6) as sd, round(stddev_pop(r), 6) as sd_pop, round((avg(r ** 3) - 3 * avg(r) * avg(r ** 2) + 2 * avg(r) ** 3) / stddev_pop(r) ** 3, 6) as skew, round(kurtosis_pop(r), 6) as kurt from ret group by 1")
def moments(spark, sf):
    return rounded(returns(spark, sf).groupBy("symbol").agg(*aggregates.moments("r")))


@query("agg14_spearman", RETURNS + ", k as (select symbol, rank() over (partition by symbol order by r) + (count(*) over (partition by symbol, r) - 1) / 2 as x, rank() over (partition by symbol order by n_bars) + (count(*) over (partition by symbol, n_bars) - 1) / 2 as y from ret where r is not null) select symbol, round(corr(x, y), 6) as rho, count(*) as n from k group by 1")
def spearman(spark, sf):
    return rounded(aggregates.spearman(returns(spark, sf), "r", "n_bars", ("symbol",)))


@query("agg15_elasticity", D + " select symbol, round(regr_slope(ln(close), ln(volume)), 6) as slope, round(regr_intercept(ln(close), ln(volume)), 6) as intercept, round(regr_r2(ln(close), ln(volume)), 6) as r2, count(*) as n from daily group by 1")
def elasticity(spark, sf):
    x, y = F.ln("volume"), F.ln("close")
    return rounded(frames.daily(spark, sf).groupBy("symbol").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n")))


@query(
    "agg16_evt02_event_ratio",
    D + f""", {frames.CALENDAR}, x as (select symbol, isodow(day) as dow, (high - low) / close as size, case when day in (select day from calendar) then 1 else 0 end as event from daily),
    g as (select symbol, dow, avg(size) filter (event = 1) as m1, avg(size) filter (event = 0) as m0, var_samp(size) filter (event = 1) as v1, var_samp(size) filter (event = 0) as v0, count(*) filter (event = 1) as n1, count(*) filter (event = 0) as n0 from x group by 1, 2)
    select symbol, cast(dow % 7 + 1 as integer) as dow, n1, n0, round(m1 / m0, 6) as ratio, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) as t from g where n1 >= 20 and n0 >= 20""",
)
def event_ratio(spark, sf):
    c = frames.calendar(spark, sf).select("day", F.lit(1).alias("event")).distinct()
    d = frames.daily(spark, sf).join(c, "day", "left").select("symbol", F.dayofweek("day").alias("dow"), ((F.col("high") - F.col("low")) / F.col("close")).alias("size"), F.coalesce("event", F.lit(0)).alias("event"))
    return rounded(aggregates.event_ratio(d, "size", "event", ("symbol", "dow"), 20))
