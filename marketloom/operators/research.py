"""Rules, text features, event studies, costs, sizing and the journal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import special

EPS = 1e-12


def literals(df: DataFrame, bins: dict[str, Column], keys: list[str]) -> DataFrame:
    """Long table of matches only: one row per row and literal `feature=bin`."""
    made = F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in bins.items()])
    return df.select(*keys, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("literal"))


def rules(df: DataFrame, features: dict[str, Column], y: str, least: int = 100, classes: int = 3) -> DataFrame:
    """Lift and z of every one- and two-literal conjunction and class.

    A row's conjunctions are built within the row (features choose two), so
    counting them is one aggregation and no self-join; literals of one feature
    never meet.
    """
    made = F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in sorted(features.items())])
    rows = df.where(F.col(y).isNotNull()).select(F.col(y).alias("y"), F.filter(made, lambda x: x.isNotNull()).alias("lit"))
    i = F.posexplode("lit").alias("i", "a")
    ones = rows.select("y", "lit", i)
    rule = F.concat(F.array(F.col("a")), F.transform(F.slice("lit", F.col("i") + 2, F.size("lit")), lambda b: F.concat(F.col("a"), F.lit(" & "), b)))
    counts = ones.select("y", F.explode(rule).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("y") == k).alias(f"k{k}") for k in range(classes)])
    base = rows.agg(*[F.avg((F.col("y") == k).cast("double")).alias(f"b{k}") for k in range(classes)])
    long = counts.where(F.col("n") >= least).crossJoin(F.broadcast(base))  # one row
    long = long.select("rule", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("y"), F.col(f"k{k}").alias("hits"), F.col(f"b{k}").alias("base")) for k in range(classes)])).alias("x"))
    p, b = F.col("x.hits") / F.col("n"), F.col("x.base")
    return long.select("rule", "x.y", "n", "x.hits", (p / b).alias("lift"), ((p - b) / F.sqrt(b * (1 - b) / F.col("n"))).alias("z"))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def density(text: Column, words: list[str], whole: bool = False) -> Column:
    """Occurrences of any of the words, as substrings or whole words."""
    total = F.lit(0).cast("long")
    for word in words:
        total = total + (F.regexp_count(text, F.lit(rf"\b{word}\b")).cast("long") if whole else occurrences(text, word))
    return total


def dominant(scores: dict[str, Column], default: str) -> Column:
    """Name with the highest score above zero; the first one in order wins ties."""
    best = F.greatest(*scores.values())
    out = F.lit(default)
    for name, s in reversed(scores.items()):
        out = F.when((s == best) & (best > 0), name).otherwise(out)
    return out


def analogs(df: DataFrame, value: str, length: int, k: int, queries: Column, key: str = "symbol", ts: str = "day") -> DataFrame:
    """For each query row, the k nearest z-normalised windows of its series that
    ended `length` rows or more before; queries: a condition on `place`.

    Queries meet the windows of their own series only; the inner product of two
    z-normalised windows gives their distance.
    """
    w = Window.partitionBy(key).orderBy(ts)
    o = w.rowsBetween(-(length - 1), 0)
    rows = df.withColumns({"place": F.row_number().over(w), "x": F.collect_list(value).over(o), "m": F.avg(value).over(o), "s": F.stddev_pop(value).over(o)})
    rows = rows.where((F.size("x") == length) & (F.col("s") > EPS))
    rows = rows.select(key, ts, "place", F.transform("x", lambda v: (v - F.col("m")) / F.col("s")).alias("x"))
    q = rows.where(queries).select(key, F.col(ts).alias("query"), F.col("place").alias("at"), F.col("x").alias("qx"))
    pairs = q.join(rows, key).where(F.col("place") + length <= F.col("at"))
    d = F.aggregate(F.zip_with("qx", "x", lambda a, b: F.pow(a - b, F.lit(2))), F.lit(0.0), lambda a, v: a + v)
    pairs = pairs.select(key, "query", F.round(d, 6).alias("d"), F.col(ts).alias("analog"))
    rank = F.row_number().over(Window.partitionBy(key, "query").orderBy("d", "analog"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def spread_cost(base: Column, sigma: Column, reference: Column, beta: Column) -> Column:
    """Spread scaled by (sigma / reference) ^ beta."""
    return base * F.pow(F.greatest(sigma, F.lit(1e-9)) / reference, beta)


def fixed_risk(sigma: Column, risk: float = 0.02, stop: float = 1.0) -> Column:
    return risk / (stop * sigma)


def kelly(mu: Column, sigma: Column, fraction: float = 1.0) -> Column:
    return fraction * mu / (sigma * sigma)


def cvar_size(sigma: Column, es: float, budget: float = 0.02) -> Column:
    return budget / (abs(es) * sigma)


def ruin_cap(sigma: Column, horizon: int = 250, budget: float = 0.01, nu: float = 6.0, ruin: float = 0.5) -> Column:
    """Leverage at which the chance to fall to the ruin level within the horizon
    is the budget (reflection: twice the chance at its end)."""
    z = special.t_quantile(budget / 2, nu) / math.sqrt(nu / (nu - 2))
    return -math.log(ruin) / F.greatest(-z * sigma * math.sqrt(horizon), F.lit(1e-9))


def portfolio_factor(k: int, rho: Column) -> Column:
    """1 / sqrt(k + k (k - 1) rho) for k positions at once."""
    if k <= 1:
        return F.lit(1.0)
    r = F.least(F.greatest(rho, F.lit(-1.0 / (k - 1) + 1e-9)), F.lit(1.0))
    return 1 / F.sqrt(k + k * (k - 1) * r)


def position(df: DataFrame, s1: Column, s2: Column, stress: Column, mu: Column, drawdown: Column, k: int = 1, rho: float = 0.3, stress_rho: float = 0.6, most: float = 30.0, slip: float = 0.9) -> DataFrame:
    """f, and the constraint that binds: the least of Kelly and the scaled ruin cap, in [0, most]."""
    sigma = F.col("sigma")
    t = F.least(F.greatest((sigma - s1) / F.greatest(s2 - s1, F.lit(EPS)), F.lit(0.0)), F.lit(1.0))
    k_vol, k_dd = 1.3 - 0.4 * t, F.least(F.greatest(1 - 2.0 * drawdown, F.lit(0.5)), F.lit(1.0))
    cap = slip * ruin_cap(sigma) * k_vol * k_dd * portfolio_factor(k, F.when(sigma >= stress, stress_rho).otherwise(rho))
    rows = df.withColumns({"kelly": kelly(mu, sigma), "cap": cap})
    f = F.least(F.greatest(F.least("kelly", "cap"), F.lit(0.0)), F.lit(most))
    why = F.when(F.col("kelly") <= 0, "no edge").when(f >= most, "leverage").when(F.col("kelly") < F.col("cap"), "kelly").otherwise("risk cap")
    return rows.withColumns({"f": f, "binding": why})


def stopping_results(df: DataFrame, path: str, stops: str, most: float, cost: float, key: str = "symbol") -> DataFrame:
    """Mean results per key of stopping at the first day whose sum is at least
    the level for the days left (stops[n - 1] for n), of holding to the end of
    the path and of closing half way; a day costs `cost`, gains end at `most`."""
    n = F.size(path)
    sums = F.transform(F.sequence(F.lit(0), n), lambda i: F.aggregate(F.slice(path, 1, i), F.lit(0.0), lambda a, v: a + v))
    rows = df.withColumn("sums", sums)
    out = F.filter(F.sequence(F.lit(0), n - 1), lambda h: F.get("sums", h) >= F.get(stops, n - h - 1))
    rows = rows.withColumn("h", F.coalesce(F.get(out, F.lit(0)), n))
    result = lambda h: F.least(F.get("sums", h), F.lit(most)) - cost * h
    half = F.floor(n / 2).cast("int")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(result(F.col("h"))).alias("optimal"), F.avg("h").alias("mean_days"), F.avg(result(n)).alias("hold"), F.avg(result(half)).alias("five_days"))


def journal_new(new: DataFrame, journal: DataFrame, last_known: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast rows to append: for days after the last known one, and not yet written."""
    return new.join(last_known, "symbol").where(F.col("day") > F.col("last_day")).drop("last_day").join(journal.select(*keys), keys, "left_anti")


def outcomes(journal: DataFrame, bars: DataFrame, h: int) -> DataFrame:
    """Journal rows with the log return of the h sessions from their day on, and its class."""
    w = Window.partitionBy("symbol").orderBy("day")
    b = bars.select("symbol", "day", (F.ln(F.lead("close", h - 1).over(w)) - F.ln(F.lag("close").over(w))).alias("r")).where("r is not null")
    rows = journal.join(b, ["symbol", "day"])
    return rows.withColumn("y", F.when(F.col("r") < -F.col("band"), 0).when(F.col("r") > F.col("band"), 2).otherwise(1))
