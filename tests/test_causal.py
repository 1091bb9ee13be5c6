"""Lead-lag relations, effects and pooled coefficients against plain regressions."""

from itertools import combinations

import numpy as np
import pytest

from marketloom.functions import special
from marketloom.operators import causal, gram


def residual(v, z):
    z = np.c_[np.ones(len(v)), z]
    return v - z @ np.linalg.lstsq(z, v, rcond=None)[0]


def test_moments_regress_any_column_on_any(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    key = rng.integers(0, 3, 300)
    y = x @ [1, -2, 0.5] + rng.normal(size=300)
    rows = [(int(k), *map(float, v), float(t)) for k, v, t in zip(key, x, y, strict=True)] + [(0, None, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, y double").repartition(5)
    names = ["a", "b", "c", "y"]
    got = {r.key: r for r in gram.regress(gram.moments(df, ["key"], names), names, ["a", "c"], "y", "f").collect()}
    for k in range(3):
        z = np.c_[np.ones((key == k).sum()), x[key == k][:, [0, 2]]]
        b, ssr, *_ = np.linalg.lstsq(z, y[key == k], rcond=None)
        assert np.allclose(got[k].f, b) and np.isclose(got[k].f_ssr, ssr[0])
    left = {r.key: r.f for r in gram.regress(gram.without_own(gram.moments(df, ["key"], names), [], 5), names, ["a"], "y", "f").collect()}
    z = np.c_[np.ones((key != 1).sum()), x[key != 1][:, 0]]
    assert np.allclose(left[1], np.linalg.lstsq(z, y[key != 1], rcond=None)[0])


@pytest.mark.parametrize("lags", [None, 0, 7])
def test_wald_has_the_bartlett_sum(spark, lags):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    n = 400
    e = np.convolve(rng.normal(size=n + 5), np.ones(4) / 2, "same")[:n]
    a, b, c = rng.normal(size=n), np.cumsum(rng.normal(size=n)) / 10, rng.normal(size=n)
    y = 0.5 * a + 0.1 * c + e
    df = spark.createDataFrame([("k", i, *map(float, r)) for i, r in enumerate(zip(a, b, c, y, strict=True))] + [("few", i, 1.0, float(i), 2.0, 1.0) for i in range(4)], "key string, t long, a double, b double, c double, y double").repartition(4)
    got = causal.hac_wald(df, ["key"], "t", ["a", "b", "c"], "y", ["b", "c"], None if lags is None else F.lit(lags)).collect()
    assert [r.key for r in got] == ["k"]
    x = np.c_[np.ones(n), a, b, c]
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    u = x * (y - x @ beta)[:, None]
    m = int(np.ceil(1.5 * n ** (1 / 3))) if lags is None else lags
    s = u.T @ u + sum((1 - j / (m + 1)) * (u[j:].T @ u[:-j] + u[:-j].T @ u[j:]) for j in range(1, m + 1))
    inv = np.linalg.inv(x.T @ x)
    v = inv @ s @ inv
    wald = beta[2:] @ np.linalg.inv(v[2:, 2:]) @ beta[2:]
    assert got[0].n == n and got[0].lags == m and np.isclose(got[0].wald, wald) and np.isclose(got[0].p, special.chi2_tail(wald, 2))


def series(seed, n=900):
    """a leads b by two rows and c by one; d is alone; b follows itself."""
    rng = np.random.default_rng(seed)
    e = rng.normal(size=(n, 4))
    x = np.zeros((n, 4))
    for t in range(n):
        x[t] = e[t]
        if t > 1:
            x[t, 1] += 0.5 * x[t - 2, 0] + 0.4 * x[t - 1, 1]
            x[t, 2] += 0.5 * x[t - 1, 0]
    return x


def plain_links(x, lags, alpha, most):
    """The same search, every test a pair of regressions on the rows."""
    n_series = x.shape[1]
    lagged = {(i, k): x[2 * lags - k : len(x) - k, i] for i in range(n_series) for k in range(2 * lags + 1)}

    def test(a, b, given):
        z = np.stack([lagged[g] for g in given], 1) if given else np.empty((len(lagged[a]), 0))
        r = np.corrcoef(residual(lagged[a], z), residual(lagged[b], z))[0, 1]
        dof = len(z) - 2 - len(given)
        return r, 2 * (1 - float(special.t_cdf(abs(r) * np.sqrt(dof / (1 - r * r)), dof)))

    parents = {}
    for j in range(n_series):
        kept = [(i, k) for k in range(1, lags + 1) for i in range(n_series)]
        for size in range(most + 1):
            kept = [c for c in kept if all(test(c, (j, 0), g)[1] <= alpha for g in combinations([o for o in kept if o != c], size))]
        parents[j] = kept
    out = {}
    for j, own in parents.items():
        for i, k in own:
            given = ({*own} | {(a, b + k) for a, b in parents[i]}) - {(i, k)}
            out[j, i, k] = test((i, k), (j, 0), sorted(given))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_regressions_over_all_subsets(spark, seed):
    x = series(seed)
    names = ["a", "b", "c", "d"]
    rows = [(names[i], t, float(x[t, i])) for t in range(len(x)) for i in range(4)] + [("a", 5000, 1.0), ("b", 5001, None)]  # days that not all have
    df = spark.createDataFrame(rows, "symbol string, day long, r double").repartition(6)
    got = {(names.index(r.target), names.index(r.source), r.lag): (r.r, r.p) for r in causal.lagged_links(df, lags=2, alpha=0.05, most=2).collect()}
    want = plain_links(x, 2, 0.05, 2)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)
    found = {k for k, (_, p) in got.items() if p < 1e-4}
    assert {(1, 0, 2), (1, 1, 1), (2, 0, 1)} <= found and not any(t == 3 for t, _, _ in found)


def test_no_links_and_too_many_series(spark):
    schema = "symbol string, day long, r double"
    assert causal.lagged_links(spark.createDataFrame([], schema)).collect() == []
    many = spark.createDataFrame([(f"s{i}", 1, 1.0) for i in range(9)], schema)
    with pytest.raises(ValueError):
        causal.lagged_links(many, most_series=8)
    assert causal.lagged_links(many).collect() == []  # one day is too short


def test_effect_under_confounding(spark):
    rng = np.random.default_rng(5)
    n = 4000
    w = rng.normal(size=(n, 2))
    d = w @ [1.0, -1.0] + rng.normal(size=n)
    y = 0.3 * d + w @ [2.0, 1.0] + rng.normal(size=n) * (1 + 0.3 * np.abs(d))
    fold = rng.integers(0, 5, n)
    df = spark.createDataFrame([("k", *map(float, r), int(f)) for r, f in zip(np.c_[w, d, y], fold, strict=True)], "key string, u double, v double, d double, y double, fold int").repartition(4)
    r = causal.partialled_out(df, ["key"], "y", "d", ["u", "v"], "fold").collect()[0]
    ry, rd = np.empty(n), np.empty(n)
    for k in range(5):
        z, o = np.c_[np.ones(n), w], fold == k
        for v, out in ((y, ry), (d, rd)):
            out[o] = v[o] - z[o] @ np.linalg.lstsq(z[~o], v[~o], rcond=None)[0]
    effect = (ry @ rd) / (rd @ rd)
    se = np.sqrt((((ry - effect * rd) * rd) ** 2).sum()) / (rd @ rd)
    assert r.n == n and np.isclose(r.effect, effect) and np.isclose(r.se, se)
    assert abs(r.effect - 0.3) < 4 * r.se < 0.2 and abs(np.polyfit(d, y, 1)[0] - 0.3) > 0.3  # plain regression is misled


def test_poolability_of_all_coefficients(spark):
    rng = np.random.default_rng(6)
    for planted in (0.0, 0.5):
        x, key = rng.normal(size=(600, 2)), np.arange(600) % 3
        y = 1 + x @ [0.5, -0.5] + planted * (key == 1) * x[:, 1] + rng.normal(size=600)
        df = spark.createDataFrame([(f"s{k}", *map(float, r), float(v)) for k, r, v in zip(key, x, y, strict=True)], "symbol string, a double, b double, y double")
        r = causal.poolability(df, "symbol", ["a", "b"], "y").collect()[0]
        rss = lambda o: float((residual(y[o], x[o]) ** 2).sum())  # noqa: E731,B023
        free = sum(rss(key == k) for k in range(3))
        assert (r.df1, r.df2) == (6, 591) and np.isclose(r.f, (rss(key >= 0) - free) / 6 / (free / 591))
        assert (r.p < 0.001) == (planted > 0)
