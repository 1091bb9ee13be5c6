"""Volatility forecasts by expanding regressions, and three-class forecasts.

Regressions: the Gram matrix of the rows before each row is a set of window
sums (one window over a symbol's rows); a batch of rows is then solved at once
in numpy.  Only the solve runs in Python, and on batches of any symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RIDGE = 1e-8


def w(ts: str = "day"):
    return Window.partitionBy("symbol").orderBy(ts)


def har_design(df: DataFrame, rv: str = "rv", ts: str = "day", month: int = 22, z_window: int = 250, gamma: float = 1.5) -> DataFrame:
    """log RV of the day, week and month, realised quarticity, semivariances and
    a logistic regime of the shifted z-score; null where a window isn't full."""
    log = lambda c: F.ln(F.greatest(F.col(c), F.lit(1e-12)))
    full = lambda c, n: F.when(F.count(c).over(w(ts).rowsBetween(1 - n, 0)) == n, F.avg(c).over(w(ts).rowsBetween(1 - n, 0)))
    rows = df.withColumns({"lv": log(rv), "lq": F.ln(F.greatest(F.sqrt(F.greatest("rq", F.lit(1e-12))) / F.greatest(F.col(rv), F.lit(1e-12)), F.lit(1e-12))), "lp": log("rsp"), "ln": log("rsn")})
    past = w(ts).rowsBetween(-z_window, -1)
    z = (F.col("lv") - F.avg("lv").over(past)) / F.greatest(F.stddev_samp("lv").over(past), F.lit(1e-8))
    rows = rows.withColumns({"lw": full("lv", 5), "lm": full("lv", month), "regime": F.when(F.count("lv").over(past) == z_window, 1 / (1 + F.exp(-gamma * z))), "y": F.lead("lv").over(w(ts))})
    return rows.withColumn("lqv", F.col("lq") * F.col("lv"))


def expanding_ols(df: DataFrame, x: list[str], y: str, ts: str = "day", window: int | None = None, least: int | None = None, ridge: float = RIDGE, residuals: bool = False) -> DataFrame:
    """df with beta (array: constant, then x): the fit on the rows before.

    window: only that many rows before.  Rows with a null in x or y don't
    count; beta is null until `least` rows do (default: twice the unknowns).
    residuals: also n_fit and ssr, the sum of squared residuals.
    """
    names = ["__one", *x]
    valid = F.lit(True)
    for c in [*x, y]:
        valid = valid & F.col(c).isNotNull()
    rows = df.withColumns({"__one": F.lit(1.0), "__ok": valid})
    before = w(ts).rowsBetween(Window.unboundedPreceding if window is None else -window, -1)
    sums = {}
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            sums[f"__a{i}_{j}"] = F.sum(F.when(F.col("__ok"), F.col(a) * F.col(names[j]))).over(before)
        sums[f"__b{i}"] = F.sum(F.when(F.col("__ok"), F.col(a) * F.col(y))).over(before)
    sums["__n"] = F.count(F.when(F.col("__ok"), 1)).over(before)
    if residuals:
        sums["__s"] = F.sum(F.when(F.col("__ok"), F.col(y) * F.col(y))).over(before)
    rows = rows.withColumns(sums)
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    need = least or 2 * k

    @F.pandas_udf("array<double>")
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            m = np.stack([c.to_numpy(float) for c in columns], 1)
            n, a, b = len(m), np.zeros((len(m), k, k)), m[:, len(pairs) : len(pairs) + k]
            for s, (i, j) in enumerate(pairs):
                a[:, i, j] = a[:, j, i] = m[:, s]
            good = (m[:, -1] >= need) & np.isfinite(m).all(1)
            out = np.empty(n, object)
            if good.any():
                beta = np.linalg.solve(a[good] + ridge * np.eye(k), b[good][:, :, None])[:, :, 0]
                for i, v in zip(np.flatnonzero(good), beta, strict=True):
                    out[i] = v.tolist()
            yield pd.Series(out)

    beta = solve(*[F.col(f"__a{i}_{j}") for i, j in pairs], *[F.col(f"__b{i}") for i in range(k)], F.col("__n").cast("double"))
    rows = rows.withColumn("beta", beta)
    if residuals:  # y'y - 2 b'X'y + b'X'X b
        b = [F.col("beta")[i] for i in range(k)]
        ssr = F.col("__s")
        for i in range(k):
            ssr = ssr - 2 * b[i] * F.col(f"__b{i}")
            for j in range(k):
                ssr = ssr + b[i] * b[j] * F.col(f"__a{min(i, j)}_{max(i, j)}")
        rows = rows.withColumns({"ssr": ssr, "n_fit": F.col("__n")})
    return rows.drop(*sums, "__one", "__ok")


def predict(df: DataFrame, x: list[str], name: str) -> DataFrame:
    total = F.col("beta")[0]
    for i, c in enumerate(x):
        total = total + F.col("beta")[i + 1] * F.col(c)
    return df.withColumn(name, total)


def simple_ols(df: DataFrame, x: str, y: str, ts: str = "day", least: int = 30) -> DataFrame:
    """slope and intercept on the rows before, all in window functions."""
    before = w(ts).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(before)
    return df.withColumns({"slope": F.when(n >= least, F.regr_slope(y, x).over(before)), "intercept": F.when(n >= least, F.regr_intercept(y, x).over(before))})


def shrink_to_panel(df: DataFrame, weight: float, size: int, ts: str = "day") -> DataFrame:
    """beta pulled toward the mean beta of all symbols on that day."""
    d = Window.partitionBy(ts)
    mixed = F.array(*[(1 - weight) * F.col("beta")[i] + weight * F.avg(F.col("beta")[i]).over(d) for i in range(size)])
    return df.withColumn("beta", F.when(F.col("beta").isNotNull(), mixed))


def geometric_mean(names: list[str]):
    """exp of the mean of log forecasts."""
    total = F.col(names[0])
    for n in names[1:]:
        total = total + F.col(n)
    return F.exp(total / len(names))


def horizon_scale(df: DataFrame, ret: str, sigma: str, h: int, train, regime: str, least: int = 100) -> DataFrame:
    """c: standard deviation of ret / (sigma sqrt h) in training, by regime where
    it has enough rows, else over all."""
    z = F.when(train, F.col(ret) / (F.col(sigma) * h**0.5))
    own = Window.partitionBy("symbol", regime)
    per, n, all_ = F.stddev_pop(z).over(own), F.count(z).over(own), F.stddev_pop(z).over(Window.partitionBy("symbol"))
    return df.withColumn("c", F.when(n >= least, per).otherwise(all_))


def band(df: DataFrame, sigma: str, n: int = 252, least: int = 60, k: float = 1.0, ts: str = "day") -> DataFrame:
    """k times the rolling median of sigma; null in the warm-up."""
    o = w(ts).rowsBetween(1 - n, 0)
    return df.withColumn("band", F.when(F.count(sigma).over(o) >= least, k * F.percentile(sigma, F.lit(0.5)).over(o)))


def label(value, edge):
    """0 below -edge, 1 inside, 2 above; null if unknown."""
    return F.when(value < -edge, 0).when(F.abs(value) <= edge, 1).when(value > edge, 2)


def frozen_class_rates(df: DataFrame, y: str, train, keys: list[str]) -> DataFrame:
    """Class frequencies in training."""
    rows = df.where(train & F.col(y).isNotNull())
    return rows.groupBy(*keys).agg(*[F.avg((F.col(y) == k).cast("double")).alias(f"p{k}") for k in range(3)])


def refit_rates(df: DataFrame, y: str, burn: int = 750, every: int = 21, ts: str = "day") -> DataFrame:
    """Class rates of all rows before the row's block; blocks of `every` rows after the burn-in."""
    rows = df.withColumn("place", F.row_number().over(w(ts)) - 1)
    rows = rows.withColumn("block", F.when(F.col("place") >= burn, F.floor((F.col("place") - burn) / every)).otherwise(-1))
    per = rows.groupBy("symbol", "block").agg(F.count(y).alias("n"), *[F.count_if(F.col(y) == k).alias(f"k{k}") for k in range(3)])
    before = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("symbol", "block", *[(F.sum(f"k{k}").over(before) / F.sum("n").over(before)).alias(f"p{k}") for k in range(3)])
    return rows.where("block >= 0").join(per, ["symbol", "block"])
