"""Lead-lag relations between series: Wald tests with long-run covariances,
lagged links by conditional independence, effects under confounding."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import special
from marketloom.operators import gram


def hac_wald(df: DataFrame, keys: list[str], ts: str, x: list[str], y: str, tested: list[str], lags: Column | None = None) -> DataFrame:
    """keys, n, lags, wald, p: do the tested columns of x say nothing about y?

    The covariance of the coefficients is a sandwich with the Bartlett sum of
    the scores' lagged products, up to `lags` (default ceil(1.5 n^(1/3))).  That
    sum equals the sum of products of the scores' moving totals over lags + 1
    rows, divided by lags + 1, the totals reaching beyond both ends.  A moving
    total is the difference of two prefix sums that an equi-join brings together,
    so the number of lags doesn't multiply the rows.  Rows with nulls don't
    count; groups with too few rows have no result.
    """
    names, size = [*x, y], len(x) + 2
    d = len(x) + 1
    sums = gram.regress(gram.moments(df, keys, names), names, x, y, "beta").where("beta is not null")
    count = F.col("m0_0")
    sums = sums.withColumn("lags", (F.ceil(1.5 * F.pow(count, F.lit(1 / 3))) if lags is None else lags).cast("int"))
    rows = df.where(gram.known(names)).join(sums.select(*keys, "beta", "lags"), keys)
    order = Window.partitionBy(*keys).orderBy(ts)
    error = F.col(y) - gram.fitted("beta", x)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "lags", F.row_number().over(order).alias("k"), *[F.sum(error * (F.col(x[i - 1]) if i else F.lit(1.0))).over(upto).alias(f"c{i}") for i in range(d)])
    ends = rows.select(*keys, F.col("k").alias("s"), *[f"c{i}" for i in range(d)])
    starts = rows.select(*keys, (F.col("k") + F.col("lags") + 1).alias("s"), *[F.col(f"c{i}").alias(f"p{i}") for i in range(d)])
    # Beyond the last row the prefix sums stay at 0: residuals are orthogonal to x.
    total = [F.coalesce(f"c{i}", F.lit(0.0)) - F.coalesce(f"p{i}", F.lit(0.0)) for i in range(d)]
    moving = ends.join(starts, [*keys, "s"], "full").select(*keys, *[t.alias(f"t{i}") for i, t in enumerate(total)])
    meat = moving.groupBy(*keys).agg(*[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"s{i}_{j}") for i, j in gram.cells(d)])
    at = [x.index(c) + 1 for c in tested]

    @F.pandas_udf("struct<wald: double, p: double>")
    def test(m: pd.Series, s: pd.Series, beta: pd.Series, n_lags: pd.Series) -> pd.DataFrame:
        bread = np.linalg.pinv(gram.unpacked(m, size)[:, :d, :d], hermitian=True)
        cov = bread @ (gram.unpacked(s, d) / (n_lags.to_numpy() + 1)[:, None, None]) @ bread
        b = np.stack([np.asarray(v, float) for v in beta])[:, at] if len(beta) else np.empty((0, len(at)))
        own = cov[:, at][:, :, at]
        wald = np.einsum("ni,nij,nj->n", b, np.linalg.pinv(own, hermitian=True), b)
        return pd.DataFrame({"wald": wald, "p": special.chi2_tail(wald, len(at))})

    out = sums.join(meat, keys).withColumn("__t", test(gram.packed(size), F.array(*[F.col(f"s{i}_{j}") for i, j in gram.cells(d)]), F.col("beta"), F.col("lags")))
    return out.select(*keys, count.cast("long").alias("n"), "lags", "__t.wald", "__t.p")


# Lagged links.


def lagged_products(df: DataFrame, names: list[str], lags: int, symbol: str = "symbol", ts: str = "day", value: str = "r", batch: int = 4096) -> tuple[np.ndarray, int]:
    """(products, rows): sums of products of a constant and of every series at
    every lag from 0 on, place 1 + lag * series + its number, over the days that
    all series have.

    The rows of a place of the common days are made by handing each value on to
    the places up to `lags` later; tasks multiply their rows in batches and one
    matrix for each task is summed.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(symbol).isin(names)).select(F.col(symbol).alias("s"), F.col(ts).alias("t"), F.col(value).cast("double").alias("v"))
    days = rows.groupBy("t").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") == len(names))
    days = days.select("t", F.row_number().over(Window.orderBy("t")).alias("k"))  # a row for each common day
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("s")) - 1
    handed = rows.join(days, "t").select("k", number.alias("i"), "v", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"))
    at = F.struct((F.col("lag") * len(names) + F.col("i")).alias("at"), "v")
    d = len(names) * (lags + 1)
    wide = handed.groupBy((F.col("k") + F.col("lag")).alias("k")).agg(F.sort_array(F.collect_list(at)).alias("x")).where(F.size("x") == d)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d + 1, d + 1))
        for pdf in batches:
            for low in range(0, len(pdf), batch):
                x = np.array([v.tolist() for v in pdf["x"].iloc[low : low + batch]], float).reshape(-1, d)
                x = np.c_[np.ones(len(x)), x]
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    parts = wide.select(F.transform("x", lambda v: v["v"]).alias("x")).mapInPandas(multiply, "at int, v double")
    found = parts.groupBy("at").agg(F.sum("v").alias("v")).collect()  # (series x lags)^2 numbers
    out = np.zeros((d + 1) ** 2)
    for r in found:
        out[r["at"]] = r["v"]
    out = out.reshape(d + 1, d + 1)
    return out, int(round(out[0, 0]))


def correlations(products: np.ndarray) -> np.ndarray:
    n, mean = products[0, 0], products[0, 1:] / max(products[0, 0], 1.0)
    cov = products[1:, 1:] / max(n, 1.0) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    return cov / np.outer(sd, sd)


def partial(corr: np.ndarray, a: int, b: int, given: list[int], n: int) -> tuple[float, float]:
    """Correlation of a and b that the given ones leave (Schur complement), and its p by Student's t."""
    at = [a, b, *given]
    c = corr[np.ix_(at, at)]
    s = c[:2, :2] - c[:2, 2:] @ gram.solve(c[2:, 2:], c[2:, :2]) if given else c
    if s[0, 0] <= 1e-10 or s[1, 1] <= 1e-10:
        return 0.0, 1.0
    r = float(np.clip(s[0, 1] / np.sqrt(s[0, 0] * s[1, 1]), -1, 1))
    dof = max(n - 2 - len(given), 1)
    t = abs(r) * np.sqrt(dof / max(1 - r * r, 1e-12))
    return r, float(2 * (1 - special.t_cdf(t, dof)))


def likely_parents(corr: np.ndarray, n: int, target: int, candidates: list[int], alpha: float, most: int) -> list[tuple[int, float]]:
    """Candidates that no set of up to `most` others makes independent of the
    target, and the least correlation they had, strongest first.  Those that
    fall at a size of sets fall together, so their order doesn't matter."""
    weakest = dict.fromkeys(candidates, np.inf)
    kept = list(candidates)
    for size in range(most + 1):
        if len(kept) <= size:
            break
        gone = set()
        for c in kept:
            for given in combinations([o for o in kept if o != c], size):
                r, p = partial(corr, c, target, list(given), n)
                weakest[c] = min(weakest[c], abs(r))
                if p > alpha:
                    gone.add(c)
                    break
        kept = [c for c in kept if c not in gone]
    return sorted(((c, float(weakest[c])) for c in kept), key=lambda x: (-x[1], x[0]))


def lagged_links(df: DataFrame, lags: int = 2, alpha: float = 0.2, most: int = 3, most_series: int = 200, symbol: str = "symbol", ts: str = "day", value: str = "r") -> DataFrame:
    """target, source, lag, weakest, r, p, n: which series lead which.

    First the parents of each series among all series at lags 1 to `lags`: those
    that stay dependent given any `most` others.  Then for each parent the
    momentary test: its partial correlation given the target's other parents and
    its own parents, so much earlier.  All tests are Schur complements of one
    matrix of lagged products, which is all that leaves the rows; it has
    (series x (2 lags + 1))^2 numbers, so more than most_series series are refused.
    """
    names = sorted(r[0] for r in df.where(F.col(value).isNotNull()).select(symbol).distinct().limit(most_series + 1).collect())
    if len(names) > most_series:
        raise ValueError(f"more than {most_series} series")
    spark, s = df.sparkSession, len(names)
    schema = "target string, source string, lag int, weakest double, r double, p double, n long"
    if not s:
        return spark.createDataFrame([], schema)
    products, n = lagged_products(df, names, 2 * lags, symbol, ts, value)
    shared = spark.sparkContext.broadcast((correlations(products), n))
    candidates = [lag * s + i for lag in range(1, lags + 1) for i in range(s)]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corr, n = shared.value
        for pdf in batches:
            for target in pdf["target"]:
                found = likely_parents(corr, n, int(target), candidates, alpha, most) if n > 2 * len(candidates) else []
                yield pd.DataFrame([(target, c % s, c // s, w) for c, w in found], columns=["target", "source", "lag", "weakest"])

    targets = spark.range(0, s, 1, min(s, 32)).select(F.col("id").cast("int").alias("target"))
    parents = targets.mapInPandas(search, "target int, source int, lag int, weakest double").checkpoint()
    lists = parents.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("lag", "source"))).alias("parents"))
    links = parents.join(lists, "target").join(lists.select(F.col("target").alias("source"), F.col("parents").alias("earlier")), "source", "left")

    def momentary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corr, n = shared.value
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                own = {p["lag"] * s + p["source"] for p in r.parents}
                earlier = {(p["lag"] + r.lag) * s + p["source"] for p in (r.earlier if r.earlier is not None else [])}
                at = r.lag * s + r.source
                rows.append((names[r.target], names[r.source], r.lag, r.weakest, *partial(corr, at, r.target, sorted((own | earlier) - {at}), n), n))
            yield pd.DataFrame(rows, columns=["target", "source", "lag", "weakest", "r", "p", "n"])

    return links.mapInPandas(momentary, schema)


def partialled_out(df: DataFrame, keys: list[str], y: str, d: str, controls: list[str], fold: str, ridge: float = 0.0) -> DataFrame:
    """keys, n, effect, se, t: effect of d on y, both freed of the controls by
    fits that haven't seen the row's fold.

    A fold's fits are from the moments of all folds less its own; the effect
    solves the orthogonal score mean((y' - effect d') d') = 0, and its error is
    that of the score.
    """
    names = [*controls, d, y]
    size = len(names) + 1
    sums = gram.without_own(gram.moments(df, [*keys, fold], names), keys, size)
    sums = gram.regress(gram.regress(sums, names, controls, y, "by", ridge=ridge), names, controls, d, "bd", ridge=ridge)
    rows = df.where(gram.known(names)).join(sums.select(*keys, fold, "by", "bd"), [*keys, fold]).where("by is not null and bd is not null")
    rows = rows.select(*keys, (F.col(y) - gram.fitted("by", controls)).alias("ry"), (F.col(d) - gram.fitted("bd", controls)).alias("rd"))
    # Sums of the score's square are a polynomial in the effect, so one pass is enough.
    a, b = F.col("ry") * F.col("rd"), F.col("rd") * F.col("rd")
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in {"a": a, "b": b, "aa": a * a, "ab": a * b, "bb": b * b}.items()])
    effect = F.col("a") / F.col("b")
    g = g.withColumn("effect", effect).withColumn("se", F.sqrt(F.greatest(F.col("aa") - 2 * effect * F.col("ab") + effect * effect * F.col("bb"), F.lit(0.0))) / F.col("b"))
    return g.select(*keys, "n", "effect", "se", (F.col("effect") / F.col("se")).alias("t"))


def poolability(df: DataFrame, key: str, x: list[str], y: str) -> DataFrame:
    """f, df1, df2, p: are all coefficients of y on x the same for all keys?  The
    restricted and the unrestricted fits come from the same moments."""
    names, k = [*x, y], len(x) + 1
    sums = gram.moments(df, [key], names)
    own = gram.regress(sums, names, x, y, "b").where("b is not null")
    both = gram.regress(gram.pooled(own.drop("b", "b_ssr"), [], k + 1), names, x, y, "b").select(F.col("b_ssr").alias("restricted"))
    own = own.agg(F.sum("b_ssr").alias("free"), F.sum("m0_0").alias("n"), F.count(F.lit(1)).alias("groups"))
    df1, df2 = k * (F.col("groups") - 1), F.col("n").cast("long") - k * F.col("groups")
    f = (F.col("restricted") - F.col("free")) / df1 / (F.col("free") / df2)

    @F.pandas_udf("double")
    def tail(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(special.incomplete_beta(q / 2, p / 2, np.array(q / (q + p * v)))) if v == v and p > 0 and q > 0 else None for v, p, q in zip(f, a, b, strict=True)])

    out = own.crossJoin(both).select(f.alias("f"), df1.alias("df1"), df2.alias("df2"))  # a row each
    return out.withColumn("p", tail("f", F.col("df1").cast("double"), F.col("df2").cast("double")))
