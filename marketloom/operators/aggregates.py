"""Grouped statistics across rows and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correlation_matrix(df: DataFrame, value: str, on: str = "day", by: str = "symbol") -> DataFrame:
    """a, b, corr, n for every pair of symbols on their common days."""
    x = df.select(on, F.col(by).alias("a"), F.col(value).alias("x"))
    y = df.select(on, F.col(by).alias("b"), F.col(value).alias("y"))
    return x.join(y, on).where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str, keys: tuple[str, ...]) -> DataFrame:
    """Rank correlation per group, ties at mean ranks."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        w = Window.partitionBy(*keys).orderBy(c)
        same = Window.partitionBy(*keys, c)
        rows = rows.withColumn(f"__r{c}", F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)
    return rows.groupBy(*keys).agg(F.corr(f"__r{x}", f"__r{y}").alias("rho"), F.count(F.lit(1)).alias("n"))


def edges(df: DataFrame, value: str, probs: tuple[float, ...], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Quantile thresholds per group as an array."""
    return df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias("edges"))


def digitize(value: Column, edges: Column) -> Column:
    """Number of edges at or below the value; null stays null."""
    return F.when(value.isNotNull(), F.size(F.filter(edges, lambda e: e <= value)))


def transitions(df: DataFrame, state: str, alpha: float = 1.0, states: int = 3, ts: str = "day", key: str = "symbol") -> DataFrame:
    """Transition counts and Laplace-smoothed probabilities between states."""
    w = Window.partitionBy(key).orderBy(ts)
    rows = df.withColumn("prev", F.lag(state).over(w)).where("prev is not null").where(F.col(state).isNotNull())
    n = rows.groupBy(key, "prev", F.col(state).alias("cur")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(key, "prev"))
    return n.withColumn("p", (F.col("n") + alpha) / (total + alpha * states))


def moments(value: str) -> list[Column]:
    """Mean, standard deviations, population skewness and excess kurtosis."""
    return [
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.stddev_pop(value).alias("sd_pop"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"),
    ]


def event_ratio(df: DataFrame, value: str, event: str, keys: tuple[str, ...], least: int) -> DataFrame:
    """Mean on event rows over the mean on others, and Welch's t, with at least `least` rows on both sides."""
    on = lambda f, v: f(F.when(F.col(event) == v, F.col(value)))
    g = df.groupBy(*keys).agg(
        on(F.avg, 1).alias("m1"), on(F.avg, 0).alias("m0"), on(F.var_samp, 1).alias("v1"), on(F.var_samp, 0).alias("v0"), on(F.count, 1).alias("n1"), on(F.count, 0).alias("n0")
    )
    g = g.where((F.col("n1") >= least) & (F.col("n0") >= least))
    return g.select(*keys, "n1", "n0", (F.col("m1") / F.col("m0")).alias("ratio"), ((F.col("m1") - F.col("m0")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))).alias("t"))
