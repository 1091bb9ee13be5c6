"""Fitted tails, tails over all rows so far, shifts and sliding windows against plain code."""

import numpy as np
import pytest

from marketloom.functions import recursive as rec
from marketloom.operators import extremes, panel


def pareto(rng, shape, scale, n):
    u = rng.random(n)
    return scale / shape * (u**-shape - 1) if shape else -scale * np.log(u)


def likelihood(x, w, shape, scale):
    return (w * (-np.log(scale) - (np.log1p(shape * x / scale) * (1 / shape + 1) if abs(shape) > 1e-9 else x / scale))).sum() / w.sum()


def test_planted_shapes_are_found(spark):
    rng = np.random.default_rng(8)
    planted = {"heavy": (0.4, 2.0), "bounded": (-0.3, 1.0), "exponential": (0.0, 0.5)}
    rows = [(k, float(v), float(w)) for k, (a, b) in planted.items() for v, w in zip(pareto(rng, a, b, 4000), rng.random(4000) + 0.5, strict=True)]
    df = spark.createDataFrame([*rows, ("few", 1.0, 1.0), ("heavy", None, 1.0), ("heavy", 1.0, 0.0)], "key string, x double, w double").repartition(5)
    got = {r.key: r for r in extremes.fit_pareto(df, ["key"]).collect()}
    assert set(got) == set(planted)
    for k, (shape, scale) in planted.items():
        assert abs(got[k].shape - shape) < 0.08 and abs(got[k].scale / scale - 1) < 0.1
        x, w = (np.array([r[i] for r in rows if r[0] == k]) for i in (1, 2))
        best = likelihood(x, w, got[k].shape, got[k].scale)
        for a in (-0.02, 0, 0.02):
            for b in (0.98, 1, 1.02):
                if 1 + (got[k].shape + a) * x.max() / (got[k].scale * b) > 0:
                    assert best >= likelihood(x, w, got[k].shape + a, got[k].scale * b) - 1e-9


def test_a_weight_of_two_is_a_row_twice(spark):
    rng = np.random.default_rng(9)
    x = pareto(rng, 0.2, 1.0, 200)
    weighted = spark.createDataFrame([("k", float(v), 1.0 + (i % 2)) for i, v in enumerate(x)], "key string, x double, w double")
    twice = spark.createDataFrame([("k", float(v), 1.0) for i, v in enumerate(x) for _ in range(1 + i % 2)], "key string, x double, w double")
    a, b = (extremes.fit_pareto(d, ["key"]).collect()[0] for d in (weighted, twice))
    assert abs(a.shape - b.shape) < 1e-6 and abs(a.scale - b.scale) < 1e-6


@pytest.mark.parametrize("kind", ["normal", "ties", "one value", "trend"])
def test_expanding_tails(spark, kind):
    rng = np.random.default_rng(10)
    n = 700
    z = {"normal": rng.normal(size=n), "ties": np.round(rng.normal(size=n)), "one value": np.where(rng.random(n) < 0.6, -1.0, rng.normal(size=n)), "trend": -np.arange(n) / 10.0}[kind]
    rows = [("a", i, float(v)) for i, v in enumerate(z)] + [("b", i, float(v)) for i, v in enumerate(z[:260])] + [("a", n, None), ("short", 0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, day long, r double").repartition(5)
    for level in (0.05, 0.5):
        got = {(r.symbol, r.day): r for r in extremes.expanding_tails(df, "r", level, burn=100, every=21).collect()}
        assert len(got) == n + 260 + 1
        for (s, t), r in got.items():
            if t < 100:
                assert r.q is None and r.tail is None
                continue
            past = z[: 100 + (t - 100) // 21 * 21]
            q = np.quantile(past, level)
            assert np.isclose(r.q, q) and np.isclose(r.tail, past[past <= r.q + 1e-12].mean()), (s, t)


def shift_table(spark, x, after):
    rows = [("k", i, *map(float, v), int(a), i * 7919 % 5) for i, (v, a) in enumerate(zip(x, after, strict=True))]
    return spark.createDataFrame(rows, "symbol string, day long, a double, b double, after int, fold int").repartition(4)


def test_shifts_are_found_and_only_they(spark):
    rng = np.random.default_rng(11)
    after = np.arange(3000) >= 2000
    still = rng.normal(size=(3000, 2))
    moved = still + np.c_[0.5 * after, np.zeros(3000)]
    shuffled = moved[rng.permutation(3000)]
    found = {}
    for name, x in {"still": still, "moved": moved, "shuffled": shuffled}.items():
        scored = extremes.shift_scores(shift_table(spark, x, after), "symbol", "after", ["a", "b"], "fold")
        r = extremes.shift_test(scored, "symbol", "after").collect()[0]
        assert (r.n_before, r.n_after) == (2000, 1000)
        found[name] = r
        rows = sorted(scored.collect(), key=lambda r: r.day)
        fold = np.array([r.fold for r in rows])
        z = np.c_[np.ones(3000), x]
        b = np.linalg.lstsq(z[fold != 2], after[fold != 2].astype(float), rcond=None)[0]
        assert np.allclose([r.score for r in rows if r.fold == 2], z[fold == 2] @ b, atol=1e-6)
    assert abs(found["still"].z) < 3 and abs(found["shuffled"].z) < 3 and found["moved"].z > 8 and 0.6 < found["moved"].auc < 0.7


def test_sliding_windows():
    rng = np.random.default_rng(12)
    z = np.round(rng.normal(size=900), 1)
    z[rng.random(900) < 0.1] = np.nan
    held = rec.Sliding(50)
    for t, v in enumerate(z):
        past = z[max(0, t - 50) : t]
        past = past[np.isfinite(past)]
        assert len(held) == len(past)
        if len(past):
            q, mean = held.tail(0.1)
            assert np.isclose(q, np.quantile(past, 0.1)) and np.isclose(mean, past[past <= q + 1e-12].mean())
        held.push(v)


def test_widths_are_order_statistics_of_the_stratum():
    rng = np.random.default_rng(13)
    n = 600
    size, wide = np.abs(rng.normal(size=n)), rng.integers(0, 2, n)
    cell = wide * 2 + (rng.random(n) < 0.05)
    half, _ = rec.stratum_widths(size, wide, cell, 150, window=200, least=40)
    level = dict.fromkeys(range(4), 0.1)
    for t in range(150, n):
        past = np.arange(max(0, t - 200), t)
        own, near = size[past][cell[past] == cell[t]], size[past][wide[past] == wide[t]]
        pool = np.sort(own if len(own) >= 40 else near if len(near) >= 40 else size[past])
        k = int(np.ceil((len(pool) + 1) * (1 - level[cell[t]])))
        assert half[t] == pool[min(max(k, 1), len(pool)) - 1]
        level[cell[t]] += 0.01 * (0.1 - (size[t] > half[t]))


def test_quiet_series_cost_little():
    import time

    rng = np.random.default_rng(14)
    start = time.perf_counter()
    assert len(rec.drifts(np.abs(rng.normal(size=40_000)))) <= 3
    rec.adaptive_tail(rng.normal(size=40_000), 0.05)
    assert time.perf_counter() - start < 20


def test_spillover_blocks_are_refits_on_the_rows_before(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(15)
    x = np.zeros((130, 2))
    for t in range(1, 130):
        x[t] = [0.4 * x[t - 1, 0], 0.5 * x[t - 1, 0] + 0.2 * x[t - 1, 1]] + rng.normal(size=2)
    rows = [(s, t, float(x[t, i])) for t in range(130) for i, s in enumerate("pq")] + [("p", 999, 1.0)]
    got = {(r.block, r["to"], r["from"]): r.share for r in panel.spillover(spark.createDataFrame(rows, "symbol string, day long, lv double"), F.floor(F.col("k") / 21)).collect()}
    assert {b for b, _, _ in got} == {1, 2, 3, 4, 5, 6}
    for block in (2, 6):
        y, z = x[1 : block * 21], np.c_[np.ones(block * 21 - 1), x[: block * 21 - 1]]
        b = np.linalg.lstsq(z, y, rcond=None)[0]
        e = y - z @ b
        s, step, num, den = e.T @ e / len(e), np.eye(2), np.zeros((2, 2)), np.zeros(2)
        for _ in range(10):
            num += (step @ s) ** 2 / np.diag(s)
            den += np.diag(step @ s @ step.T)
            step = b[1:].T @ step
        share = num / den[:, None]
        share /= share.sum(1, keepdims=True)
        assert np.allclose([[got[block, a, c] for c in "pq"] for a in "pq"], share, atol=1e-6)
