"""Rules, text, event studies, costs, sizing, decisions and the journal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import hashed
from marketloom.operators import bars, research
from marketloom.operators import indicators as ind
from marketloom.operators import tfidf as tfidf_blocks
from marketloom.plans import series_sql as ssql
from marketloom.plans.catalog import query, rounded
from marketloom.plans.relational_queries import BINS, RETURNS, binned, returns
from marketloom.sources import frames

D = f"with {frames.DAILY}"

RULES = BINS + """, f as (select symbol, day, bin as y, 'back=' || lag(bin) over w as a, 'busy=' || (n_bars >= 8)::integer as b, 'dow=' || isodow(day) as c, 'two=' || lag(bin, 2) over w as d from b join daily using (symbol, day) window w as (partition by symbol order by day)),
  l as (select y, list_filter([a, b, c, d], lambda x: x is not null) as lit from f where y is not null),
  r as (select y, unnest(list_concat(lit, flatten(list_transform(range(1, len(lit) + 1), lambda i: list_transform(lit[i + 1:], lambda z: lit[i] || ' & ' || z))))) as rule from l),
  n as (select rule, count(*) as n from r group by 1 having count(*) >= 100), t as (select count(*)::double as t from l), base as (select y, count(*) / t as base from l, t group by y, t),
  h as (select n.rule, base.y, n, (select count(*) from r where r.rule = n.rule and r.y = base.y) as hits, base from n, base)
  select rule, y, n, hits, round(hits / n / base, 6) as lift, round((hits / n - base) / sqrt(base * (1 - base) / n), 5) as z from h"""


def rule_rows(spark, sf):
    b = binned(spark, sf)
    w = ind.w()
    d = frames.daily(spark, sf).select("symbol", "day", F.col("n_bars").alias("nb"))
    rows = b.join(d, ["symbol", "day"]).withColumns({"l1": F.lag("bin").over(w), "l2": F.lag("bin", 2).over(w)})
    dow = F.when(F.dayofweek("day") == 1, 7).otherwise(F.dayofweek("day") - 1)
    return rows, {"back": F.col("l1"), "busy": (F.col("nb") >= 8).cast("int"), "dow": dow, "two": F.col("l2")}


@query("rul01_03_rule_lifts", RULES)
def rule_lifts(spark, sf):
    rows, features = rule_rows(spark, sf)
    return rounded(research.rules(rows, features, "bin"), 6, z=5)


@query("rul04_07_leave_one_out", BINS + """, f as (select symbol, bin as y, lag(bin) over (partition by symbol order by day) as p from b), s as (select x.symbol as left_out, p, y from f, (select distinct symbol from f) x where f.symbol <> x.symbol and y is not null),
  g as (select left_out, p, count(*) as n, avg((y = 2)::integer) as rate from s where p is not null group by 1, 2), b0 as (select left_out, avg((y = 2)::integer) as base from s group by 1) select left_out, p as before, n, round(rate / base, 6) as lift from g join b0 using (left_out)""")
def leave_one_out(spark, sf):
    rows = binned(spark, sf).withColumn("p", F.lag("bin").over(ind.w())).where("bin is not null")
    per = rows.groupBy("symbol", "p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bin") == 2).alias("k"))
    # Sums over all symbols less the one left out: no pass per symbol.
    w, all_ = Window.partitionBy("p"), Window.partitionBy()
    own = Window.partitionBy("symbol")
    per = per.withColumns({"bn": F.sum("n").over(all_) - F.sum("n").over(own), "bk": F.sum("k").over(all_) - F.sum("k").over(own), "on": F.sum("n").over(w) - F.col("n"), "ok": F.sum("k").over(w) - F.col("k")})
    per = per.where("p is not null")
    return rounded(per.select(F.col("symbol").alias("left_out"), F.col("p").alias("before"), F.col("on").alias("n"), (F.col("ok") / F.col("on") / (F.col("bk") / F.col("bn"))).alias("lift")))


@query("rul05_decile_dummies", RETURNS + ", q as (select symbol, quantile_cont(n_bars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from daily group by 1) select symbol, len(list_filter(e, lambda x: x <= n_bars))::integer as decile, count(*) as n, round(avg(r), 6) as mean_r from ret join q using (symbol) group by 1, 2")
def deciles(spark, sf):
    from marketloom.operators import aggregates

    r = returns(spark, sf)
    e = aggregates.edges(r, "n_bars", tuple(i / 10 for i in range(1, 10)))
    rows = r.join(F.broadcast(e), "symbol").withColumn("decile", aggregates.digitize(F.col("n_bars"), F.col("edges")))  # a row per symbol
    return rounded(rows.groupBy("symbol", "decile").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r")))


@query("rul06_common_factor", RETURNS + ", z as (select symbol, day, (r - avg(r) over s) / stddev_samp(r) over s as z from ret where r is not null window s as (partition by symbol)) select day, round(avg(z), 5) as factor, count(*) as n from z group by 1")
def common_factor(spark, sf):
    s = Window.partitionBy("symbol")
    z = returns(spark, sf).where("r is not null").withColumn("z", (F.col("r") - F.avg("r").over(s)) / F.stddev_samp("r").over(s))
    return rounded(z.groupBy("day").agg(F.avg("z").alias("factor"), F.count(F.lit(1)).alias("n")), 5)


@query("rul09_sax_transitions", BINS + """, g as (select symbol, bin as y, lag(bin, 1) over w + 3 * lag(bin, 2) over w as code from b window w as (partition by symbol order by day)), n as (select code, y, count(*) as hits, sum(count(*)) over (partition by code) as n from g where code is not null and y is not null group by 1, 2),
  base as (select bin as y, count(*) / (select count(*)::double from b where bin is not null) as base from b where bin is not null group by 1) select code::integer as code, y, hits, n::bigint as n, round(hits / n::double / base, 6) as lift, round((hits / n::double - base) / sqrt(base * (1 - base) / n::double), 5) as z from n join base using (y)""")
def sax(spark, sf):
    b = binned(spark, sf)
    g = b.withColumn("code", F.lag("bin", 1).over(ind.w()) + 3 * F.lag("bin", 2).over(ind.w())).where("bin is not null")
    n = g.where("code is not null").groupBy("code", F.col("bin").alias("y")).agg(F.count(F.lit(1)).alias("hits"))
    n = n.withColumn("n", F.sum("hits").over(Window.partitionBy("code")))
    base = g.groupBy(F.col("bin").alias("y")).agg(F.count(F.lit(1)).alias("c")).withColumn("base", F.col("c") / F.sum("c").over(Window.partitionBy()))
    p, q = F.col("hits") / F.col("n"), F.col("base")
    return rounded(n.join(F.broadcast(base), "y").select("code", "y", "hits", "n", (p / q).alias("lift"), ((p - q) / F.sqrt(q * (1 - q) / F.col("n"))).alias("z")), 6, z=5)  # a row per class


@query("rul10_motifs")
def motifs(spark, sf):
    """K-means on z-normalised windows: windows and mean next return by motif."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    o = ind.over(8)
    rows = returns(spark, sf).withColumns({"x": F.collect_list("close").over(o), "m": F.avg("close").over(o), "s": F.stddev_pop("close").over(o), "next": F.lead("r").over(ind.w())}).where("size(x) = 8 and s > 0")
    rows = rows.withColumn("features", array_to_vector(F.transform("x", lambda v: (v - F.col("m")) / F.col("s"))))
    model = KMeans(k=6, seed=1, maxIter=15).fit(rows)
    return model.transform(rows).groupBy(F.col("prediction").alias("motif")).agg(F.count(F.lit(1)).alias("n"), F.avg("next").alias("mean_next"))


@query("rul11_rule_list")
def rule_list(spark, sf):
    """A shallow decision tree on lagged states: accuracy by split."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows, f = rule_rows(spark, sf)
    rows = rows.select("day", F.col("bin").cast("double").alias("label"), *[c.cast("double").alias(k) for k, c in f.items()]).dropna()
    rows = VectorAssembler(inputCols=list(f), outputCol="features").transform(rows).withColumn("train", F.col("day") < F.lit("1999-10-13").cast("date"))
    model = DecisionTreeClassifier(maxDepth=3, seed=1).fit(rows.where("train"))
    return model.transform(rows).groupBy("train").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


@query("rul12_autocorrelation_regime", RETURNS + """, p as (select *, lag(r) over (partition by symbol order by day) as b from ret), c as (select symbol, day, r, case when count(case when r is not null and b is not null then 1 end) over w = 19 then corr(r, b) over w end as ac from p window w as (partition by symbol order by day rows between 18 preceding and current row)),
  g as (select symbol, day, case when ac < -0.5 then 'reverting' when ac > 0 then 'trending' else 'mixed' end as regime, lead(r) over (partition by symbol order by day) * sign(r) as follow from c where ac is not null) select symbol, regime, count(*) as n, round(avg(follow), 6) as follow from g group by 1, 2""")
def ac_regime(spark, sf):
    a = ind.autocorrelation(returns(spark, sf), "r", 20).where("autocorr is not null")
    regime = F.when(F.col("autocorr") < -0.5, "reverting").when(F.col("autocorr") > 0, "trending").otherwise("mixed")
    a = a.withColumns({"regime": regime, "follow": F.lead("r").over(ind.w()) * F.signum("r")})
    return rounded(a.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("follow").alias("follow")))


@query("rul13_hidden_markov")
def hidden_markov(spark, sf):
    from marketloom.functions import recursive as rec

    def f(r):
        _, sd, _, p = rec.hidden_states(r)
        return {"p_calm": p[:, 0], "p_wild": p[:, 1], "sd_calm": np.full(len(r), sd[0]), "sd_wild": np.full(len(r), sd[1])}

    return ind.per_symbol(returns(spark, sf).where("r is not null"), ["r"], dict.fromkeys(("p_calm", "p_wild", "sd_calm", "sd_wild"), "double"), f)


@query("rul14_analogs", D + """, h as (select symbol, day, row_number() over (partition by symbol order by day) as place, list(close) over (partition by symbol order by day rows between 9 preceding and current row) as x from daily), z as (select symbol, day, place, list_transform(x, lambda v: (v - list_avg(x)) / list_stddev_pop(x)) as x from h where len(x) = 10 and list_stddev_pop(x) > 1e-12),
  p as (select q.symbol, q.day as query, z.day as analog, round(list_sum(list_transform(range(1, 11), lambda i: (q.x[i] - z.x[i]) ** 2)), 6) as d from z q join z on q.symbol = z.symbol and z.place + 10 <= q.place where q.place % 50 = 0) select symbol, query, d, analog, rank::integer as rank from (select *, row_number() over (partition by symbol, query order by d, analog) as rank from p) where rank <= 5""")
def analogs(spark, sf):
    return research.analogs(frames.daily(spark, sf), "close", 10, 5, F.col("place") % 50 == 0)


WORDS = {"hawk": ["the", "tion", "ing"], "dove": ["and", "ent", "re"]}
TOPICS = {"prices": ["in", "er"], "jobs": ["on", "th"], "growth": ["an", "es"]}


def _count_sql(words: list[str]) -> str:
    return "(" + " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in words) + ")"


NW = "len(regexp_extract_all(text, '[^\\s]+'))"


def previous(df, key: str, value):
    """df with before: value of the row with the next smaller key.  Ranges of keys
    keep the order parallel; a range's first row takes the last of the ranges
    before, which are a row each."""
    rows = df.withColumns({"part": F.floor(F.col(key) / 100_000), "value": value})
    last = rows.groupBy("part").agg(F.max_by("value", key).alias("carry"))
    last = last.select("part", F.lag("carry").over(Window.orderBy("part")).alias("carry"))
    own = F.lag("value").over(Window.partitionBy("part").orderBy(key))
    return rows.withColumn("own", own).join(last, "part").withColumn("before", F.coalesce("own", "carry")).drop("part", "value", "own", "carry")


@query("txt02_length_change", f"select doc_id, {NW} as words, round({NW} / nullif(lag({NW}) over (order by doc_id), 0)::double - 1, 6) as change from documents")
def length_change(spark, sf):
    d = frames.table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("words"))
    d = previous(d, "doc_id", F.col("words"))
    return rounded(d.select("doc_id", "words", (F.col("words") / F.nullif(F.col("before"), F.lit(0).cast("long")) - 1).alias("change")))


@query("txt03_tone", f"select doc_id, round(({_count_sql(WORDS['hawk'])} - {_count_sql(WORDS['dove'])}) / nullif({NW}, 0)::double, 6) as tone from documents")
def tone(spark, sf):
    t = F.col("text")
    score = (research.density(t, WORDS["hawk"]) - research.density(t, WORDS["dove"])) / F.nullif(F.regexp_count(t, F.lit(r"\S+")), F.lit(0))
    return rounded(frames.table(spark, sf, "documents").select("doc_id", score.alias("tone")))


@query("txt03_tone_whole_words", "select doc_id, (len(regexp_extract_all(lower(text), '\\bthe\\b')) - len(regexp_extract_all(lower(text), '\\band\\b')))::bigint as net from documents where lang = 'en'")
def tone_words(spark, sf):
    t = F.lower("text")
    return frames.table(spark, sf, "documents").where("lang = 'en'").select("doc_id", (research.density(t, ["the"], True) - research.density(t, ["and"], True)).alias("net"))


@query("txt04_dominant_topic", f"with c as (select doc_id, {_count_sql(TOPICS['prices'])} as p, {_count_sql(TOPICS['jobs'])} as j, {_count_sql(TOPICS['growth'])} as g from documents) select doc_id, case when greatest(p, j, g) = 0 then 'none' when p = greatest(p, j, g) then 'prices' when j = greatest(p, j, g) then 'jobs' else 'growth' end as topic from c")
def topic(spark, sf):
    scores = {k: research.density(F.col("text"), v) for k, v in TOPICS.items()}
    return frames.table(spark, sf, "documents").select("doc_id", research.dominant(scores, "none").alias("topic"))


@query("txt01_tfidf_change", ssql.TFIDF)
def tfidf(spark, sf):
    """One less the cosine of neighbouring statements' TF-IDF vectors of one and
    two words.  Every term counts; frequencies are summed over blocks of
    documents, so no vector is as wide as the vocabulary."""
    d = frames.table(spark, sf, "documents").where(F.col("text").rlike(r"\S"))
    return rounded(tfidf_blocks.changes(d.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))))


@query("txt05_embedding_components")
def components(spark, sf):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = frames.table(spark, sf, "embeddings").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    p = vector_to_array("pca")
    return PCA(k=3, inputCol="features", outputCol="pca").fit(e).transform(e).select("vec_id", *[F.round(F.abs(p[i]), 5).alias(f"size{i}") for i in range(3)])


@query("txt06_label_axes", "with a as (select list_transform(range(1, 65), lambda i: i) as k), m as (select label, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) r(i) where label in (0, 1) group by 1, 2), x as (select i, max(m) filter (label = 1) - max(m) filter (label = 0) as w from m group by 1), l as (select list(w order by i) as w from x) select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * w[i])), 5) as axis from embeddings, l")
def label_axes(spark, sf):
    e = frames.table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    m = e.where("label in (0, 1)").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("i").agg((F.avg(F.when(F.col("label") == 1, F.col("v"))) - F.avg(F.when(F.col("label") == 0, F.col("v")))).alias("w"))
    axis = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("w"))  # one row of 64 numbers
    dot = F.aggregate(F.zip_with("embedding", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return rounded(e.crossJoin(F.broadcast(axis)).select("vec_id", dot.alias("axis")), 5)


@query("evt01_event_study", RETURNS + f""", {frames.CALENDAR}, m as (select symbol, day, r, quantile_cont(abs(r), 0.5) over (partition by symbol order by day rows between 20 preceding and 1 preceding) as med, count(r) over (partition by symbol order by day rows between 20 preceding and 1 preceding) as n from ret)
  select symbol, (day in (select day from calendar)) as event, count(*) as n, round(quantile_cont(abs(r) / med, 0.5), 6) as ratio, round(avg((r > 0)::integer), 6) as up from m where n = 20 and med > 0 and r is not null group by 1, 2""")
def event_study(spark, sf):
    o = ind.w().rowsBetween(-20, -1)
    rows = returns(spark, sf).withColumns({"med": F.percentile(F.abs("r"), F.lit(0.5)).over(o), "k": F.count("r").over(o)}).where("k = 20 and med > 0 and r is not null")
    c = frames.calendar(spark, sf).select("day", F.lit(True).alias("event")).distinct()
    rows = rows.join(c, "day", "left").withColumn("event", F.coalesce("event", F.lit(False)))
    return rounded(rows.groupBy("symbol", "event").agg(F.count(F.lit(1)).alias("n"), F.percentile(F.abs("r") / F.col("med"), F.lit(0.5)).alias("ratio"), F.avg((F.col("r") > 0).cast("double")).alias("up")))


GAPS = f"""with {frames.OTHER_DAILY}, g as (select symbol, day, day - lag(day) over w as days, ln(open) - ln(lag(close) over w) as jump, ln(close) - ln(lag(close) over w) as r from other_daily window w as (partition by symbol order by day)),
  s as (select *, case when count(r) over w = 20 then stddev_samp(r) over w end as sigma from g window w as (partition by symbol order by day rows between 20 preceding and 1 preceding)), z as (select symbol, days >= 3 as weekend, abs(jump) / sigma as z from s where jump is not null and sigma > 0)"""


def gaps(spark, sf):
    """weekend (three days or more since the bar before) and z, the size of the opening jump in deviations."""
    w = ind.w()
    g = frames.other_daily(spark, sf).select("symbol", "day", F.datediff("day", F.lag("day").over(w)).alias("days"), (F.ln("open") - F.ln(F.lag("close").over(w))).alias("jump"), (F.ln("close") - F.ln(F.lag("close").over(w))).alias("r"))
    o = w.rowsBetween(-20, -1)
    s = g.withColumn("sigma", F.when(F.count("r").over(o) == 20, F.stddev_samp("r").over(o))).where("jump is not null and sigma > 0")
    return s.select("symbol", (F.col("days") >= 3).alias("weekend"), (F.abs("jump") / F.col("sigma")).alias("z"))


@query("evt03_weekend_gap", GAPS + " select symbol, weekend, count(*) as n, round(quantile_cont(z, 0.5), 6) as median, round(quantile_cont(z, 0.9), 6) as p90, round(quantile_cont(z, 0.99), 6) as p99, round(max(z), 6) as most from z group by 1, 2")
def weekend_gap(spark, sf):
    q = lambda p: F.percentile("z", F.lit(p))
    return rounded(gaps(spark, sf).groupBy("symbol", "weekend").agg(F.count(F.lit(1)).alias("n"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("z").alias("most")))


@query("evt03_stop_jumps", GAPS + " select weekend, k::double as stop, count(*) as n, round(avg((z > k)::integer), 6) as jumped, round(coalesce(avg(case when z > k then z - k end), 0), 6) as beyond from z, (values (1.0), (1.5), (2.0), (3.0)) v(k) group by 1, k")
def stop_jumps(spark, sf):
    """How often a jump passes a stop of so many deviations, and how far beyond it goes."""
    rows = gaps(spark, sf).withColumn("stop", F.explode(F.array(*[F.lit(k) for k in (1.0, 1.5, 2.0, 3.0)])))
    over = F.col("z") > F.col("stop")
    return rounded(rows.groupBy("weekend", "stop").agg(F.count(F.lit(1)).alias("n"), F.avg(over.cast("double")).alias("jumped"), F.coalesce(F.avg(F.when(over, F.col("z") - F.col("stop"))), F.lit(0.0)).alias("beyond")))


COST = f"""with c as (select case when ts < timestamp '2024-01-16' then 'first' else 'second' end as regime, event_type as symbol, hour(ts)::integer as hour, quantile_cont(value, 0.5) as med, quantile_cont(value, 0.95) as p95, count(*) as n from events group by 1, 2, 3),
  e as (select event_type as symbol, stddev_samp(value) as ref from events group by 1), x as (select c.*, med * (greatest(1.2 * ref, 1e-9) / ref) ** 0.4::double as scaled from c join e using (symbol))"""


def cost_table(spark, sf):
    t = frames.ticks(spark, sf).withColumn("regime", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "first").otherwise("second"))
    c = t.groupBy("regime", "symbol", F.hour("ts").alias("hour")).agg(F.percentile("price", F.lit(0.5)).alias("med"), F.percentile("price", F.lit(0.95)).alias("p95"), F.count(F.lit(1)).alias("n"))
    e = t.groupBy("symbol").agg(F.stddev_samp("price").alias("ref"))
    return c.join(F.broadcast(e), "symbol").withColumn("scaled", research.spread_cost(F.col("med"), 1.2 * F.col("ref"), F.col("ref"), F.lit(0.4)))  # a row per symbol


@query("cst01_cost_lookup", COST + " select regime, symbol, hour, n, round(med, 6) as med, round(p95, 6) as p95, round(scaled, 6) as scaled, round(scaled + 0.35, 6) as round_trip from x")
def cost_lookup(spark, sf):
    return rounded(cost_table(spark, sf).select("regime", "symbol", "hour", "n", "med", "p95", "scaled", (F.col("scaled") + 0.35).alias("round_trip")))


@query("cst02_cheapest_hours", COST + " select regime, symbol, hour from (select *, row_number() over (partition by regime, symbol order by round(med, 6), hour) as k from x) where k <= 6")
def cheapest(spark, sf):
    k = F.row_number().over(Window.partitionBy("regime", "symbol").orderBy(F.round("med", 6), "hour"))
    return cost_table(spark, sf).withColumn("k", k).where("k <= 6").select("regime", "symbol", "hour")


SLIPPAGE = f"""with {frames.HOURLY}, x as (select *, ts::date as day, first_value(open) over w as start from hourly window w as (partition by symbol, ts::date order by ts)),
  h as (select *, start * (1 - d) as stop from x, (values (0.01), (0.05), (0.2)) v(d) where low <= start * (1 - d) and start > 0), f as (select *, (stop - low) / start as slip, row_number() over (partition by symbol, day, d order by ts) as k from h)"""


@query("cst03_slippage_table", SLIPPAGE + " select symbol, d::double as distance, count(*) as n, round(quantile_cont(slip, 0.5), 6) as med, round(quantile_cont(slip, 0.95), 6) as p95, round(avg(slip) / d, 6) as of_distance from f where k = 1 group by symbol, d")
def slippage_table(spark, sf):
    s = bars.slippage(frames.hourly(spark, sf), (0.01, 0.05, 0.2))
    return rounded(s.groupBy("symbol", "distance").agg(F.count(F.lit(1)).alias("n"), F.percentile("slip_low", F.lit(0.5)).alias("med"), F.percentile("slip_low", F.lit(0.95)).alias("p95"), (F.avg("slip_low") / F.col("distance")).alias("of_distance")), 6, distance=9)


@query("cst04_sign_backtest", ssql.sign_backtest(RETURNS))
def sign_backtest(spark, sf):
    from marketloom.functions import recursive as rec

    r = returns(spark, sf).where("r is not null")
    s = ind.per_symbol(r, ["r"], {"signal": "double"}, lambda r: {"signal": np.sign(rec.ema(r, 20))})
    rows = r.join(s, ["symbol", "day"]).withColumns({"held": F.lag("signal").over(ind.w())}).withColumn("turn", F.abs(F.col("held") - F.lag("held").over(ind.w())))
    gross = F.col("held") * F.col("r")
    return rounded(rows.groupBy("symbol").agg(F.avg(gross).alias("gross"), F.avg(gross - 0.001 * F.coalesce("turn", F.lit(0.0))).alias("net"), F.avg("turn").alias("turnover")))


@query("cst05_06_cross_section_long_short", RETURNS + """, s as (select symbol, day, r, lag(r) over (partition by symbol order by day) as sig from ret), k as (select day, r, sig, rank() over (partition by day order by sig desc, symbol) as top, rank() over (partition by day order by sig, symbol) as low, count(*) over (partition by day) as n from s where sig is not null and r is not null)
  select year(day)::integer as year, round(avg(case when top = 1 then r when low = 1 then -r end), 6) as long_short, round(avg((sign(sig) = sign(r))::integer), 6) as hit from k where n = 3 group by 1""")
def long_short(spark, sf):
    rows = returns(spark, sf).withColumn("sig", F.lag("r").over(ind.w())).where("sig is not null and r is not null")
    d = Window.partitionBy("day")
    rows = rows.withColumns({"top": F.rank().over(d.orderBy(F.col("sig").desc(), "symbol")), "low": F.rank().over(d.orderBy("sig", "symbol")), "k": F.count(F.lit(1)).over(d)}).where("k = 3")
    leg = F.when(F.col("top") == 1, F.col("r")).when(F.col("low") == 1, -F.col("r"))
    return rounded(rows.groupBy(F.year("day").alias("year")).agg(F.avg(leg).alias("long_short"), F.avg((F.signum("sig") == F.signum("r")).cast("double")).alias("hit")))


SIZ = RETURNS + ", s as (select symbol, day, stddev_samp(r) over w as sigma, avg(r) over w as mu, count(r) over w as n from ret window w as (partition by symbol order by day rows between 59 preceding and current row)), q as (select symbol, quantile_cont(sigma, [0.3333, 0.6667, 0.95]) as q from s where n = 60 and day < date '1999-10-13' group by 1)"


def sized(spark, sf):
    o = ind.over(60)
    s = returns(spark, sf).withColumns({"sigma": F.stddev_samp("r").over(o), "mu": F.avg("r").over(o), "k": F.count("r").over(o)}).where("k = 60")
    q = s.where(F.col("day") < F.lit("1999-10-13").cast("date")).groupBy("symbol").agg(F.percentile("sigma", F.array(F.lit(0.3333), F.lit(0.6667), F.lit(0.95))).alias("q"))
    return s.join(F.broadcast(q), "symbol")  # a row per symbol


CAP = "(0.9 * {c} / greatest(sigma * sqrt(250), 1e-9) * (1.3 - 0.4 * least(greatest((sigma - q[1]) / greatest(q[2] - q[1], 1e-12), 0), 1)) / sqrt(3 + 6 * case when sigma >= q[3] then 0.6 else 0.3 end))"


def _cap_constant() -> float:
    import math

    from marketloom.functions import special

    return -math.log(0.5) / -(special.t_quantile(0.005, 6.0) / math.sqrt(6.0 / 4.0))


@query("siz01_03_position", SIZ + f", f as (select symbol, day, sigma, mu / (sigma * sigma) as kelly, {CAP.format(c=_cap_constant())} as cap from s join q using (symbol) where n = 60) select symbol, day, round(kelly, 5) as kelly, round(cap, 5) as cap, round(least(greatest(least(kelly, cap), 0), 30), 5) as f, case when kelly <= 0 then 'no edge' when least(kelly, cap) >= 30 then 'leverage' when kelly < cap then 'kelly' else 'risk cap' end as binding from f")
def position(spark, sf):
    rows = research.position(sized(spark, sf), F.col("q")[0], F.col("q")[1], F.col("q")[2], F.col("mu"), F.lit(0.0), k=3)
    return rounded(rows.select("symbol", "day", "kelly", "cap", "f", "binding"), 5)


FALL = ", c as (select symbol, day, sum(coalesce(r, 0)) over (partition by symbol order by day) / 10 as cum from ret), dd as (select symbol, day, 1 - exp(cum - max(cum) over (partition by symbol order by day)) as dd from c)"


@query("siz02_drawdown_cap", SIZ + FALL + f", f as (select symbol, day, dd, mu / (sigma * sigma) as kelly, {CAP.format(c=_cap_constant())} * least(greatest(1 - 2 * dd, 0.5), 1) as cap from s join q using (symbol) join dd using (symbol, day) where n = 60) select symbol, day, round(dd, 6) as drawdown, round(cap, 5) as cap, round(least(greatest(least(kelly, cap), 0), 30), 5) as f from f")
def drawdown_cap(spark, sf):
    """The cap falls with the account's drawdown, to one half at most (a tenth of each return is earned)."""
    cum = returns(spark, sf).withColumn("cum", F.sum(F.coalesce("r", F.lit(0.0))).over(ind.w()) / 10)
    dd = cum.select("symbol", "day", (1 - F.exp(F.col("cum") - F.max("cum").over(ind.w()))).alias("drawdown"))
    rows = sized(spark, sf).join(dd, ["symbol", "day"])
    rows = research.position(rows, F.col("q")[0], F.col("q")[1], F.col("q")[2], F.col("mu"), F.col("drawdown"), k=3)
    return rounded(rows.select("symbol", "day", "drawdown", "cap", "f"), 5, drawdown=6)


@query("siz01_fixed_and_cvar", SIZ + " select symbol, day, round(0.02 / sigma, 6) as fixed, round(0.5 * mu / (sigma * sigma), 5) as half_kelly, round(0.02 / (2.3378 * sigma), 6) as cvar from s where n = 60")
def fixed_and_cvar(spark, sf):
    s = F.col("sigma")
    return rounded(sized(spark, sf).select("symbol", "day", research.fixed_risk(s).alias("fixed"), research.kelly(F.col("mu"), s, 0.5).alias("half_kelly"), research.cvar_size(s, -2.3378).alias("cvar")), 6, half_kelly=5)


@query("siz04_05_equity_paths", ssql.equity_paths(RETURNS))
def equity_paths(spark, sf):
    """Block-bootstrap equity paths: ruin, worst drawdown and final equity, and
    how often a path ends, and how often it ever lies, a fifth below its start."""
    r = returns(spark, sf).where("r is not null").select("symbol", "day", (F.col("r") / 100).alias("r"))
    part = r.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(7))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, rows = pdf.sort_values("day")["r"].to_numpy(), []
        for b in range(int(pdf["part"].iloc[0]), 200, 8):
            start = (hashed.uniforms(f"9|{b}", 25) * len(x)).astype(int)
            path = np.exp(np.cumsum(5 * x[(start[:, None] + np.arange(10)).ravel() % len(x)]))
            peak = np.maximum.accumulate(path)
            rows.append((pdf["symbol"].iloc[0], b, float(path[-1]), float((1 - path / peak).max()), float(np.sqrt(((1 - path / peak) ** 2).mean())), bool((path <= 0.5).any()), bool(path[-1] <= 0.8), bool((path <= 0.8).any())))
        return pd.DataFrame(rows, columns=["symbol", "path", "final", "drawdown", "ulcer", "ruin", "ended_low", "was_low"])

    paths = part.groupBy("symbol", "part").applyInPandas(run, "symbol string, path long, final double, drawdown double, ulcer double, ruin boolean, ended_low boolean, was_low boolean")
    return rounded(paths.groupBy("symbol").agg(F.count(F.lit(1)).alias("paths"), F.avg("final").alias("final"), F.avg("drawdown").alias("drawdown"), F.avg("ulcer").alias("ulcer"), *[F.avg(F.col(c).cast("double")).alias(c) for c in ("ruin", "ended_low", "was_low")]))


@query("dec01_touch_probability", RETURNS + """, h as (select symbol, list(r) over (partition by symbol order by day rows between 1 following and 10 following) as x from ret), w as (select symbol, list_min(list_transform(range(1, 11), lambda i: list_sum(x[1:i]))) as low, list_sum(x) as e from h where len(x) = 10) select symbol, count(*) as n, round(avg((low <= -1)::integer), 6) as touched, round(avg((e <= -1)::integer), 6) as ended, round(avg((low <= -1)::integer) / nullif(avg((e <= -1)::integer), 0), 6) as reflection from w group by 1""")
def touch(spark, sf):
    rows = returns(spark, sf).withColumn("x", F.collect_list("r").over(ind.w().rowsBetween(1, 10))).where(F.size("x") == 10)
    start = F.struct(F.lit(0.0).alias("at"), F.lit(float("inf")).alias("low"))
    rows = rows.withColumn("p", F.aggregate("x", start, lambda a, v: F.struct((a["at"] + v).alias("at"), F.least(a["low"], a["at"] + v).alias("low"))))
    t, e = F.avg((F.col("p.low") <= -1).cast("double")), F.avg((F.col("p.at") <= -1).cast("double"))
    return rounded(rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), t.alias("touched"), e.alias("ended"), F.try_divide(t, e).alias("reflection")))


@query("dec02_horizon_sigmas", RETURNS + ", h as (select symbol, k, sum(r) over (partition by symbol, k order by day rows between k - 1 preceding and current row) as s, count(r) over (partition by symbol, k order by day rows between k - 1 preceding and current row) as n from ret, (values (1), (5), (20)) v(k)), g as (select symbol, stddev_pop(r) as s1 from ret group by 1) select symbol, k::integer as horizon, round(stddev_pop(s), 6) as sigma, round(stddev_pop(s) / (any_value(s1) * sqrt(k)), 6) as factor from h join g using (symbol) where n = k group by 1, 2, k")
def horizon_sigmas(spark, sf):
    r = returns(spark, sf)
    parts = None
    for k in (1, 5, 20):
        o = ind.over(k)
        s = r.select("symbol", F.lit(k).alias("horizon"), F.when(F.count("r").over(o) == k, F.sum("r").over(o)).alias("s"))
        parts = s if parts is None else parts.unionByName(s)
    one = r.groupBy("symbol").agg(F.stddev_pop("r").alias("s1"))
    g = parts.groupBy("symbol", "horizon").agg(F.stddev_pop("s").alias("sigma")).join(one, "symbol")
    return rounded(g.select("symbol", "horizon", "sigma", (F.col("sigma") / (F.col("s1") * F.sqrt("horizon"))).alias("factor")))


@query("dec04_optimal_stopping", ssql.optimal_stopping(RETURNS))
def optimal_stopping(spark, sf):
    """Value of holding up to n days with a stop cost, by backward induction on
    each symbol's returns: 40 quantiles of them and a grid of 121 states."""
    q = returns(spark, sf).where("r is not null").groupBy("symbol").agg(F.percentile("r", F.array(*[F.lit((i + 0.5) / 40) for i in range(40)])).alias("q"))

    def induce(batches):
        grid = np.linspace(-3, 3, 121)
        stop = np.minimum(grid, 1.5)
        for pdf in batches:
            rows = []
            for symbol, moves in zip(pdf["symbol"], pdf["q"], strict=True):
                value = stop
                for n in range(1, 11):
                    ahead = np.interp(np.clip(grid[:, None] + np.asarray(moves)[None, :], -3, 3), grid, value).mean(1) - 0.002
                    value = np.maximum(stop, ahead)
                    at = np.flatnonzero(stop >= ahead)
                    rows.append((symbol, n, round(float(value[60]), 6), round(float(grid[at[0]]), 6) if len(at) else None))
            yield pd.DataFrame(rows, columns=["symbol", "days_left", "value", "stop_at"])

    return q.mapInPandas(induce, "symbol string, days_left int, value double, stop_at double")


@query("jrn01_append_only", D + """, l as (select symbol, max(day) as last_day from daily where day < date '2001-06-01' group by 1), j as (select symbol, day from daily where day between date '2001-06-10' and date '2001-06-20'), n as (select symbol, day, close from daily where day >= date '2001-05-20' and day < date '2001-07-01')
  select symbol, day, close from n join l using (symbol) where day > last_day and (symbol, day) not in (select symbol, day from j)""")
def journal(spark, sf):
    d = frames.daily(spark, sf).select("symbol", "day", "close")
    known = d.where("day < date '2001-06-01'").groupBy("symbol").agg(F.max("day").alias("last_day"))
    return research.journal_new(d.where("day >= date '2001-05-20' and day < date '2001-07-01'"), d.where("day between date '2001-06-10' and date '2001-06-20'"), known, ["symbol", "day"])


@query("jrn02_outcomes", D + ", b as (select symbol, day, ln(lead(close, 4) over w) - ln(lag(close) over w) as r from daily window w as (partition by symbol order by day)) select symbol, day, round(r, 6) as r, case when r < -0.3 then 0 when r > 0.3 then 2 else 1 end as y from b where r is not null and year(day) = 2000")
def outcomes(spark, sf):
    d = frames.daily(spark, sf)
    j = d.where("year(day) = 2000").select("symbol", "day", F.lit(0.3).alias("band"))
    return rounded(research.outcomes(j, d, 5).select("symbol", "day", "r", "y"))


@query("jrn03_rolling_calibration", D + ", b as (select symbol, day, ln(lead(close, 4) over w) - ln(lag(close) over w) as r from daily window w as (partition by symbol order by day)), o as (select symbol, day, (abs(r) <= 0.3)::integer as flat from b where r is not null) select symbol, day, round(case when count(*) over w >= 30 then avg(flat) over w end, 6) as rate from o window w as (partition by symbol order by day rows between 249 preceding and current row)")
def rolling_calibration(spark, sf):
    d = frames.daily(spark, sf)
    o = research.outcomes(d.select("symbol", "day", F.lit(0.3).alias("band")), d, 5)
    w = ind.over(250)
    return rounded(o.select("symbol", "day", F.when(F.count(F.lit(1)).over(w) >= 30, F.avg((F.col("y") == 1).cast("double")).over(w)).alias("rate")))
