"""Proper scores, calibration, backtests, conformal sets and inference."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import hashed

EPS = 1e-12


def qlike(h: Column, p: Column) -> Column:
    """log h + p / h."""
    return F.ln(h) + p / h


def qlike_ratio(h: Column, p: Column) -> Column:
    """r - log r - 1 with r = p / h."""
    r = p / h
    return r - F.ln(r) - 1


def pinball(q: Column, y: Column, tau: Column) -> Column:
    return F.greatest(tau * (y - q), (tau - 1) * (y - q))


def log_score(p: Column) -> Column:
    return -F.ln(F.greatest(p, F.lit(EPS)))


def picked(y: Column, probs: list[Column]) -> Column:
    out = F.lit(None).cast("double")
    for k, p in enumerate(probs):
        out = F.when(y == k, p).otherwise(out)
    return out


def brier(y: Column, probs: list[Column]) -> Column:
    total = F.lit(0.0)
    for k, p in enumerate(probs):
        total = total + F.pow(p - F.when(y == k, 1.0).otherwise(0.0), F.lit(2))
    return total


def skill(score: Column, reference: Column) -> Column:
    return 1 - F.avg(score) / F.avg(reference)


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """bin, n, mean probability and rate of outcomes."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10, least: int = 30) -> DataFrame:
    """ECE and MCE over bins with at least `least` rows."""
    r = reliability(df, p, y, bins).where(F.col("n") >= least)
    gap = F.abs(F.col("p") - F.col("rate"))
    return r.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def auc(df: DataFrame, score: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the curve per group: ranks with ties at their mean, from one
    sum per distinct score, so no task sorts rows."""
    g = df.groupBy(*keys, score).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(score)
    g = g.withColumn("before", F.sum("n").over(w) - F.col("n"))
    rank = F.col("before") + (F.col("n") + 1) / 2
    pos, total = F.sum("pos"), F.sum("n")
    return g.groupBy(*keys).agg(((F.sum(rank * F.col("pos")) - pos * (pos + 1) / 2) / F.nullif(pos * (total - pos), F.lit(0))).alias("auc"), pos.alias("pos"), (total - pos).alias("neg"))


def stratified_auc(df: DataFrame, score: str, y: str, stratum: str) -> DataFrame:
    """Mean of the strata's areas, weighted by positives x negatives."""
    a = auc(df, score, y, (stratum,)).where("auc is not null")
    weight = F.col("pos") * F.col("neg")
    return a.agg((F.sum(F.col("auc") * weight) / F.sum(weight)).alias("auc"), F.count(F.lit(1)).alias("strata"))


def macro_f1(df: DataFrame, y: str, guess: str, classes: int = 3) -> DataFrame:
    parts = []
    for k in range(classes):
        hit, said, true = F.count_if((F.col(y) == k) & (F.col(guess) == k)), F.count_if(F.col(guess) == k), F.count_if(F.col(y) == k)
        parts.append(F.coalesce(F.try_divide(2 * hit, said + true), F.lit(0.0)))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.agg(F.avg((F.col(y) == F.col(guess)).cast("double")).alias("accuracy"), (total / classes).alias("macro_f1"))


def crps_sample(df: DataFrame, value: str, y: str, keys: tuple[str, ...]) -> DataFrame:
    """CRPS of a sample per group, by order statistics: mean |x - y| less
    sum((2i - n - 1) x_(i)) / n^2."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(value)), F.count(F.lit(1)).over(w)
    rows = df.withColumn("__g", (2 * i - n - 1) * F.col(value))
    count = F.count(F.lit(1))
    return rows.groupBy(*keys).agg((F.avg(F.abs(F.col(value) - F.col(y))) - F.sum("__g") / (count * count)).alias("crps"))


def crps_grid(df: DataFrame, quantiles: str, taus: list[float], y: str) -> Column:
    """Twice the pinball loss integrated over the quantile levels (trapezoid)."""
    loss = [pinball(F.col(quantiles)[i], F.col(y), F.lit(t)) for i, t in enumerate(taus)]
    total = F.lit(0.0)
    for i in range(1, len(taus)):
        total = total + (loss[i] + loss[i - 1]) / 2 * (taus[i] - taus[i - 1])
    return 2 * total


def kupiec(hits: Column, n: Column, p: float) -> Column:
    """LR of unconditional coverage; null without hits or without misses."""
    x = hits / n
    lr = -2 * ((n - hits) * math.log(1 - p) + hits * math.log(p) - (n - hits) * F.ln(1 - x) - hits * F.ln(x))
    return F.when((hits > 0) & (hits < n), lr)


def christoffersen(df: DataFrame, hit: str, key: str = "symbol", ts: str = "day") -> DataFrame:
    """Transition counts of hits and the LR of independence."""
    rows = df.withColumn("__b", F.lag(hit).over(Window.partitionBy(key).orderBy(ts))).where("__b is not null")
    c = {f"n{a}{b}": F.count_if((F.col("__b") == a) & (F.col(hit) == b)) for a in (0, 1) for b in (0, 1)}
    g = rows.groupBy(key).agg(*[v.cast("double").alias(k) for k, v in c.items()])
    a, b, c_, d = (F.col(f"n{x}") for x in ("00", "01", "10", "11"))
    xlog = lambda n, p: F.when(n > 0, n * F.ln(p)).otherwise(0.0)
    p = (b + d) / (a + b + c_ + d)
    p0, p1 = F.try_divide(b, a + b), F.try_divide(d, c_ + d)
    lr = -2 * (xlog(a + c_, 1 - p) + xlog(b + d, p) - xlog(a, 1 - p0) - xlog(b, p0) - xlog(c_, 1 - p1) - xlog(d, p1))
    return g.select(key, *[F.col(k).cast("long").alias(k) for k in c], F.when((b + d > 0) & (c_ + d > 0), lr).alias("lr"))


def fz0(y: Column, q: Column, es: Column, p: float) -> Column:
    """Joint loss of quantile and tail mean (both negative)."""
    return -F.when(y <= q, (q - y) / (p * es)).otherwise(0.0) + q / es + F.ln(-es) - 1


def conformal_threshold(df: DataFrame, score: str, alpha: float, keys: tuple[str, ...]) -> DataFrame:
    """The k-th smallest score with k = ceil((n + 1)(1 - alpha)); null if k > n."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(score)), "__n": F.count(F.lit(1)).over(w)})
    k = F.ceil((F.col("__n") + 1) * F.lit(1 - alpha) - 1e-9)
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("__i") == k, F.col(score))).alias("threshold"), F.max("__n").alias("n"))


def newey_west_dm(df: DataFrame, d: str, key: str, ts: str) -> DataFrame:
    """Diebold-Mariano statistic with Bartlett weights and L = ceil(1.5 n^(1/3)).

    Lags are window lags; one pass gives all autocovariances of a series.
    """
    n = df.groupBy(key).agg(F.avg(d).alias("__m"), F.count(d).alias("__n"))
    most = n.agg(F.max(F.ceil(1.5 * F.pow("__n", F.lit(1 / 3))))).first()[0] or 0
    w = Window.partitionBy(key).orderBy(ts)
    rows = df.where(F.col(d).isNotNull()).join(F.broadcast(n) if n.count() < 100_000 else n, key).withColumn("__e", F.col(d) - F.col("__m"))
    lags = [F.lag("__e", k).over(w).alias(f"__e{k}") for k in range(1, int(most) + 1)]
    rows = rows.select(key, "__e", "__m", "__n", *lags)
    last = F.ceil(1.5 * F.pow(F.first("__n"), F.lit(1 / 3)))
    var = F.avg(F.col("__e") * F.col("__e"))
    for k in range(1, int(most) + 1):
        gamma = F.sum(F.col("__e") * F.col(f"__e{k}")) / F.first("__n")
        var = var + F.when(last >= k, 2 * (1 - k / (last + 1)) * gamma).otherwise(0.0)
    return rows.groupBy(key).agg((F.first("__m") / F.sqrt(var / F.first("__n"))).alias("dm"), F.first("__n").alias("n"))


def fdr(df: DataFrame, p: str, dependent: bool = False, ranges: int = 4096) -> DataFrame:
    """Benjamini-Hochberg (dependent: Benjamini-Yekutieli) adjusted p-values.

    Equal p-values have equal results, so distinct ones are ranked: ranges of p
    are counted first, and each range is ordered by itself, from the count of
    the ranges before and with the least value of those after.  The p-values are
    fixed first: a mean computed again may differ in its last bits, and the
    results are joined to them by value.
    """
    spark = df.sparkSession
    df = df.checkpoint()
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("range", F.floor(F.col("p") * ranges).cast("int"))
    sizes = counts.groupBy("range").agg(F.sum("n").alias("size"))
    ordered = Window.orderBy("range")  # a row for each range
    sizes = sizes.select("range", (F.sum("size").over(ordered) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))
    scale = F.lit(1.0)
    if dependent:
        total = counts.agg(F.sum("n")).first()[0] or 0
        scale = F.lit(spark.range(1, total + 1).agg(F.sum(1 / F.col("id"))).first()[0])
    own = Window.partitionBy("range").orderBy("p")
    rows = counts.join(sizes, "range").withColumn("raw", F.col("p") * F.col("total") * scale / (F.col("before") + F.sum("n").over(own)))
    least = rows.groupBy("range").agg(F.min("raw").alias("least"))
    after = least.select("range", F.min("least").over(Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    inside = F.min("raw").over(Window.partitionBy("range").orderBy(F.col("p").desc()))
    q = rows.withColumn("inside", inside).join(after, "range").select(F.col("p").alias(p), F.least(F.lit(1.0), "inside", "later").alias("q"))
    return df.join(q, p, "left")


def weighted_quantile(df: DataFrame, value: str, weight: str, level: float, key: str, ts: str) -> DataFrame:
    """Per key, the least value at which the share of weight reaches the level, and the plain quantile."""
    w = Window.partitionBy(key)
    upto = F.sum(weight).over(w.orderBy(value, ts)) / F.sum(weight).over(w)
    rows = df.withColumn("upto", upto)
    return rows.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("upto") >= level, F.col(value))), F.max(value)).alias(f"q{int(level * 100)}"), F.percentile(value, F.lit(level)).alias("plain"))


def permuted_runs(df: DataFrame, value: str, run: int, draws: int, key: str = "symbol", place: str = "place") -> DataFrame:
    """key, draw, place, value: the values in `draws` orders of runs of `run`
    rows.  The order is that of a hash, so it is the same on every run; draws of
    a key are ordered apart."""
    rows = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    h = F.md5(F.concat_ws("|", key, "draw", F.floor(F.col(place) / run).cast("string")))
    moved = F.row_number().over(Window.partitionBy(key, "draw").orderBy("h", place)) - 1
    return rows.withColumn("h", h).withColumn("moved", moved).select(key, "draw", F.col("moved").alias(place), value)


def crps_student4(y: Column, scale: Column, key: list[str], paths: int) -> Column:
    """CRPS of scale x Student t (4) from `paths` draws: E|X - y| less half of E|X - X'|.
    Uniform numbers are digits of hashes of the key; a normal over the root of a
    chi-square, both made of logarithms, is the draw."""
    text = [F.col(c) for c in key]

    def draw(j: Column) -> Column:
        a, b = hashed.digest(*text, j), hashed.digest(*text[::-1], j)
        return scale * hashed.normal(a) / F.sqrt(-2 * (F.ln(hashed.half(b)) + F.ln(hashed.half(b, 14))) / 4)

    x = F.transform(F.sequence(F.lit(1), F.lit(paths)), draw)
    mean = lambda a, n: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
    apart = F.zip_with(F.slice(x, 1, paths // 2), F.slice(x, paths // 2 + 1, paths // 2), lambda a, b: F.abs(a - b))
    return mean(F.transform(x, lambda v: F.abs(v - y)), paths) - 0.5 * mean(apart, paths // 2)


def step_down(statistics: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Westfall-Young step-down p-values: (1 + b) / (B + 1) against the running
    maximum from the weakest hypothesis up, made monotone in rejection order."""
    order = np.argsort(-statistics)
    worst = np.maximum.accumulate(null[:, order[::-1]], axis=1)[:, ::-1]
    p = (1 + (worst >= statistics[order]).sum(0)) / (len(null) + 1)
    out = np.empty(len(p))
    out[order] = np.maximum.accumulate(p)
    return out


def bootstrap(df: DataFrame, columns: list[str], statistic, replicates: int, block: int, key: str = "symbol", ts: str = "day", seed: int = 5, tasks: int = 16) -> DataFrame:
    """Block bootstrap of statistic(arrays) per key: one row per replicate.

    Replicates of a key are spread over tasks; the starts of a replicate's blocks
    are hashed numbers, so results don't depend on partitions.
    """
    part = df.select(key, ts, *columns).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        x, n, rows = [pdf[c].to_numpy(float) for c in columns], len(pdf), []
        for b in range(int(pdf["part"].iloc[0]), replicates, tasks):
            start = (hashed.uniforms(f"{seed}|{b}", -(-n // block)) * n).astype(int)
            at = ((start[:, None] + np.arange(block)[None, :]).ravel() % n)[:n]
            rows.append((pdf[key].iloc[0], b, float(statistic(*[v[at] for v in x]))))
        return pd.DataFrame(rows, columns=[key, "replicate", "value"])

    return part.groupBy(key, "part").applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, replicate long, value double")


def interval(replicates: DataFrame, level: float = 0.95, key: str = "symbol") -> DataFrame:
    a = (1 - level) / 2
    return replicates.groupBy(key).agg(F.percentile("value", F.lit(a)).alias("low"), F.percentile("value", F.lit(1 - a)).alias("high"), F.count(F.lit(1)).alias("replicates"))


def stationary_means(df: DataFrame, columns: list[str], ts: str, replicates: int = 500, block: int = 10, seed: int = 3) -> DataFrame:
    """replicate, n and the columns' means over a stationary bootstrap's rows.

    A replicate walks through the rows in order and jumps with probability
    1 / block; jumps and where to are hashed numbers.  The row of a step is that
    of its last jump and the steps since, which one window finds; so replicates
    are rows in Spark, and df (one series, a row for each time) is joined once.
    """
    over = Window.partitionBy()
    rows = df.select(ts, *columns).withColumns({"k": F.row_number().over(Window.orderBy(ts)) - 1, "n": F.count(F.lit(1)).over(over)})  # a row for each time
    steps = rows.select(F.col("k").alias("t"), "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    h = hashed.digest(F.lit(seed), F.col("replicate"), F.col("t"))
    jump = F.when((F.col("t") == 0) | (hashed.half(h) < 1 / block), F.struct("t", F.floor(hashed.half(h, 14) * F.col("n")).alias("to")))
    last = F.last(jump, ignorenulls=True).over(Window.partitionBy("replicate").orderBy("t"))
    drawn = steps.withColumn("jump", last).select("replicate", "n", ((F.col("jump.to") + F.col("t") - F.col("jump.t")) % F.col("n")).alias("k"))
    return drawn.join(rows.drop("n", ts), "k").groupBy("replicate", "n").agg(*[F.avg(c).alias(c) for c in columns])


def _circular_means(x: np.ndarray, replicates: int, block: int, seed: int) -> np.ndarray:
    n = len(x)
    at = (np.random.default_rng(seed).integers(0, n, (replicates, -(-n // block)))[:, :, None] + np.arange(block)).reshape(replicates, -1)[:, :n] % n
    return x[at].mean(1)


def confidence_set(losses: np.ndarray, names: list[str], replicates: int = 500, block: int = 10, seed: int = 3) -> list[tuple[str, float]]:
    return eliminated(losses.mean(0), _circular_means(losses, replicates, block, seed), names)


def eliminated(means: np.ndarray, boots: np.ndarray, names: list[str]) -> list[tuple[str, float]]:
    """Model confidence set by the range statistic, from means and those of
    replicates: (model, p-value)."""
    alive, out, p_run = list(range(len(names))), {}, 0.0
    while len(alive) > 1:
        d = means[alive][:, None] - means[alive][None, :]
        bd = boots[:, alive][:, :, None] - boots[:, alive][:, None, :] - d
        sd = np.sqrt((bd**2).mean(0)) + EPS
        t, tb = np.abs(d / sd).max(), np.abs(bd / sd).max((1, 2))
        p_run = max(p_run, float((tb >= t).mean()))
        worst = alive[int((d / sd).max(1).argmax())]
        out[worst] = p_run
        alive.remove(worst)
    out[alive[0]] = 1.0
    return [(n, out[i]) for i, n in enumerate(names)]


def superior_ability(d: np.ndarray, replicates: int = 500, block: int = 10, seed: int = 3) -> float:
    return consistent_p(d.mean(0), _circular_means(d, replicates, block, seed), len(d))


def consistent_p(mean: np.ndarray, boots: np.ndarray, n: int) -> float:
    """Hansen's consistent p-value that no model beats the benchmark; means over
    n rows of the benchmark's loss less each model's, and those of replicates."""
    sd = np.sqrt(((boots - mean) ** 2).mean(0) * n) + EPS
    t = max(0.0, float((math.sqrt(n) * mean / sd).max()))
    centre = np.where(mean >= -sd * math.sqrt(2 * math.log(math.log(n)) / n), mean, 0.0)
    tb = np.maximum(0, (math.sqrt(n) * (boots - centre) / sd).max(1))
    return float((1 + (tb >= t).sum()) / (len(boots) + 1))


def confidence_and_superiority(df: DataFrame, columns: list[str], ts: str, replicates: int = 500, block: int = 10, seed: int = 3) -> DataFrame:
    """model, mcs_p and spa_p (of the first model as benchmark) of losses with a
    row for each time.  The last step sees a row for each replicate."""
    boots = stationary_means(df, columns, ts, replicates, block, seed)
    means = df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, b, n = pdf[[f"mean_{c}" for c in columns]].to_numpy()[0], pdf[columns].to_numpy(), int(pdf["n"].iloc[0])
        spa = consistent_p(own[0] - own[1:], b[:, :1] - b[:, 1:], n) if n > 15 and len(columns) > 1 else None
        return pd.DataFrame([(c, p, spa) for c, p in eliminated(own, b, columns)], columns=["model", "mcs_p", "spa_p"])

    return boots.crossJoin(means).groupBy().applyInPandas(run, "model string, mcs_p double, spa_p double")  # one row of means


def sharpe_parts(value: str) -> list[Column]:
    """Sharpe ratio and the deviation of its estimate (skew and kurtosis)."""
    s = F.avg(value) / F.stddev_samp(value)
    spread = F.sqrt((1 - F.skewness(value) * s + (F.kurtosis(value) + 2) / 4 * s * s) / (F.count(value) - 1))
    return [s.alias("sharpe"), spread.alias("spread")]


def overfitting(blocks: np.ndarray) -> float:
    """PBO by CSCV; blocks: mean performance of (block, strategy)."""
    from itertools import combinations

    s, m = blocks.shape
    low = 0
    total = 0
    for half in combinations(range(s), s // 2):
        rest = [i for i in range(s) if i not in half]
        best = int(blocks[list(half)].mean(0).argmax())
        out = blocks[rest].mean(0)
        low += (out < out[best]).sum() + 1 <= (m + 1) / 2
        total += 1
    return low / total
