"""Operators without SQL against plain code or planted truth."""

import itertools

import numpy as np
import pytest

from marketloom.functions import recursive as rec
from marketloom.functions import tails
from marketloom.operators import forecast, scoring
from marketloom.plans import adaptive_queries as aq
from marketloom.plans import forecast_queries as fq
from marketloom.sources import sinks


def best_cuts(x, penalty, least, step):
    """Least squares over every set of cuts."""
    places = [b for b in range(step, len(x), step)]
    value = lambda cuts: sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in itertools.pairwise([0, *cuts, len(x)])) + penalty * (len(cuts) + 1)
    sets = [c for k in range(4) for c in itertools.combinations(places, k) if all(b - a >= least for a, b in itertools.pairwise([0, *c, len(x)]))]
    return list(min(sets, key=value))


def test_breaks_against_every_set():
    rng = np.random.default_rng(2)
    for seed in range(12):
        x = np.concatenate([np.full(n, m) for n, m in zip(rng.integers(8, 25, 3), rng.normal(0, 2, 3), strict=True)]) + rng.normal(0, 0.4, 1)
        x = x + rng.normal(0, 0.5, len(x))
        assert rec.breaks(x, 3.0, least=6, step=3) == best_cuts(x, 3.0, 6, 3), seed


def test_drifts_follow_changes():
    rng = np.random.default_rng(6)
    flat = [rec.drifts(np.abs(rng.normal(size=1500))) for _ in range(10)]
    assert sum(map(len, flat)) <= 1
    for _ in range(5):
        x = np.abs(rng.normal(size=1500) * np.where(np.arange(1500) < 700, 1, 2.5))
        found = rec.drifts(x)
        assert found and 700 < found[0] < 850
        assert rec.drifts(x[:900]) == [t for t in found if t <= 900]  # known in time


def test_components_of_vectors(spark):
    from marketloom.plans import research_queries

    sf = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x = np.array([r.embedding for r in rows], float)
    _, v = np.linalg.eigh(np.cov(x.T))
    want = np.abs(x @ v[:, ::-1][:, :3])
    got = sorted(research_queries.components(spark, sf).collect(), key=lambda r: r.vec_id)
    assert np.allclose([[r.size0, r.size1, r.size2] for r in got], want, atol=2e-5)


def test_scale_fit_finds_clusters_of_size():
    rng = np.random.default_rng(4)
    away, z = 0.0, []
    for _ in range(3000):
        s = np.exp(away)
        z.append(s * rng.standard_t(6))
        away = 0.98 * away + 0.12 * ((7) * z[-1] ** 2 / (6 * s * s + z[-1] ** 2) - 1)
    response, memory, _ = tails.fit_scale(np.array(z))
    assert response >= 0.06 and memory >= 0.94
    flat = tails.fit_scale(rng.standard_t(6, 3000))
    assert flat[0] <= 0.04
    path = tails.scale_paths(np.array(z), np.array([response]), np.array([memory]), 6.0, 0.0)[:, 0]
    cut = tails.scale_paths(np.array(z[:500]), np.array([response]), np.array([memory]), 6.0, 0.0)[:, 0]
    assert np.allclose(path[:500], cut)  # known before each row


def test_levels_keep_their_rate():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 1, 3000) * np.repeat([1, 3, 1], 1000)
    q, es, level = rec.adaptive_tail(z, 0.05)
    ok = ~np.isnan(q)
    assert abs((z[ok] <= q[ok]).mean() - 0.05) < 0.01 and (es[ok] <= q[ok] + 1e-12).all()
    half, cell = rec.stratum_widths(np.abs(z), (np.arange(3000) % 2), (np.arange(3000) % 2) * 2, 500)
    assert np.isnan(half[:500]).all() and abs((np.abs(z[500:]) > half[500:]).mean() - 0.1) < 0.02 and set(cell) == {0, 2}


def test_weighted_spillover(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.symbol, r.day): r.weighted for r in aq.weighted_spillover(spark, sf).collect()}
    share = {(r.year, r["to"], r["from"]): r.share for r in fq.spillover(spark, sf).collect()}
    assert all(abs(sum(v for (y, t, _), v in share.items() if (y, t) == k) - 1) < 1e-9 for k in {(y, t) for y, t, _ in share})
    series = {}
    for r in fq.log_variance(spark, sf).collect():
        series.setdefault(r.symbol, []).append((r.day, r.lv))
    z = {}
    for s, rows in series.items():
        rows.sort()
        v = np.array([x for _, x in rows])
        for i, (d, _) in enumerate(rows):
            if i >= 60:
                z[s, d] = (v[i] - v[:i].mean()) / max(v[:i].std(ddof=1), 1e-12)
    checked = 0
    for (to, d), value in list(got.items())[:300]:
        others = {s: share[d.year, to, s] for s in series if s != to and (d.year, to, s) in share}
        total = sum(others.values())
        assert value == pytest.approx(sum(w / total * z[s, d] for s, w in others.items() if (s, d) in z), abs=2e-5)
        checked += 1
    assert checked > 100


def test_false_discovery_with_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(400) ** 3, 2).tolist() + [0.0, 1.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)] + [(999, None)], "i int, p double")
    for dependent in (False, True):
        n, order = len(p), np.argsort(p, kind="stable")
        scale = sum(1 / k for k in range(1, n + 1)) if dependent else 1.0
        raw = np.array(p)[order] * n * scale / np.arange(1, n + 1)
        want = np.empty(n)
        want[order] = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
        got = {r.i: r.q for r in scoring.fdr(df, "p", dependent, ranges=16).collect()}
        assert got[999] is None and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in range(n))


def test_residual_sums(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=60), rng.normal(size=60)
    df = spark.createDataFrame([("a", i, float(x[i]), float(y[i])) for i in range(60)], "symbol string, day int, x double, y double")
    rows = sorted(forecast.expanding_ols(df, ["x"], "y", least=10, residuals=True).collect(), key=lambda r: r.day)
    for t in (10, 30, 59):
        d = np.c_[np.ones(t), x[:t]]
        e = y[:t] - d @ np.linalg.lstsq(d, y[:t], rcond=None)[0]
        assert rows[t].ssr == pytest.approx(float(e @ e), rel=1e-6) and rows[t].n_fit == t


def test_swap_and_exports(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    for k in range(3):
        sinks.swap(spark.range(k + 1), path)
        assert spark.read.parquet(path).count() == k + 1
        if k:
            assert spark.read.parquet(path + "_prev").count() == k
    df = spark.createDataFrame([(1, float("nan"), "a,b"), (2, 0.5, None)], "id int, x double, s string")
    sinks.export_json(df, f"file://{tmp_path}/json")
    back = spark.read.json(f"file://{tmp_path}/json").orderBy("id").collect()
    assert back[0].x is None and back[1].x == 0.5
    sinks.export_csv(df, f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).where("id = 1").first().s == "a,b"
