"""Forecasts from past blocks, rules, stacks and bootstraps against plain code and planted truth."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from marketloom.operators import experts, scoring


def test_rates_of_past_blocks(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s, n in (("a", 400), ("b", 90)):
        y, g = rng.integers(0, 3, n), rng.integers(0, 2, n)
        rows += [(s, t, int(y[t]) if rng.random() > 0.1 else None, int(g[t])) for t in range(n)]
    df = experts.place_in_blocks(spark.createDataFrame(rows, "symbol string, day long, y int, g int").repartition(5), 5, burn=50, every=21)
    block = lambda p: (p - 50) // 21 + 1 if p >= 50 else 0
    for by in ([], ["g"]):
        got = {(r.symbol, r.day): r for r in experts.past_rates(df, "y", by, "p").collect()}
        assert len(got) == len(rows)
        for s, t, _, g in rows:
            if block(t) == 0:
                assert got[s, t].p0 is None
                continue
            seen = [y for u, v, y, h in rows if u == s and block(v + 5) < block(t) and y is not None and (not by or h == g)]
            want = [(seen.count(k) + 1) / (len(seen) + 3) for k in range(3)]
            assert np.allclose([got[s, t][f"p{k}"] for k in range(3)], want)


def planted(spark, n=3000, seed=2):
    """Class 2 mostly where a > 0.3 and b <= 0.5, class 0 where a <= 0.3, else 1; c is noise."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3))
    y = np.where(x[:, 0] <= 0.3, 0, np.where(x[:, 1] <= 0.5, 2, 1))
    y = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), y)
    rows = [(i, *map(float, v), float(k), i < 2000) for i, (v, k) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*rows, (n, None, 0.5, 0.5, 1.0, True)], "day long, a double, b double, c double, y double, train boolean").repartition(3)


def losses(df, classes=3):
    from pyspark.ml.functions import vector_to_array

    p = df.withColumn("p", vector_to_array("probability")).select("y", "p").toPandas()
    own = np.array([-np.log(v[int(k)]) for k, v in zip(p["y"], p["p"], strict=True)])
    share = np.bincount(p["y"].astype(int), minlength=classes) / len(p)
    return own.mean(), -np.log(share[p["y"].astype(int)]).mean()


def test_planted_rules_are_found(spark):
    df = planted(spark)
    model, rules = experts.fit_rule_ensemble(df.where("train"), ["a", "b", "c"], "y")
    assert all({i for i, _, _ in r} <= {0, 1, 2} for r in rules) and len({tuple(r) for r in rules}) == len(rules)
    own, climate = losses(model.transform(experts.rule_vector(df.where("not train"), rules, ["a", "b", "c"])))
    assert own < 0.6 * climate
    some = df.where("a is not null").limit(50)
    got = some.withColumn("r", experts.rule_columns(rules, ["a", "b", "c"])).collect()
    for r in got:
        assert list(r.r) == [float(all((r[i + 1] <= t) if low else (r[i + 1] > t) for i, t, low in rule)) for rule in rules]


def test_stack_leans_on_the_forecast_that_knows(spark):
    rng = np.random.default_rng(3)
    n = 3000
    y = rng.integers(0, 3, n)
    good = np.full((n, 3), 0.15)
    good[np.arange(n), np.where(rng.random(n) < 0.7, y, rng.integers(0, 3, n))] = 0.7
    bad = rng.dirichlet([2, 2, 2], n)
    rows = [(float(k), *map(float, g), *map(float, b), i < 2000) for i, (k, g, b) in enumerate(zip(y, good, bad, strict=True))]
    names = [f"{e}{k}" for e in ("g", "b") for k in range(3)]
    df = spark.createDataFrame(rows, "y double, " + ", ".join(f"{c} double" for c in names) + ", train boolean")
    model = experts.fit_stack(df.where("train"), names, "y")
    own, climate = losses(model.transform(experts.stack_vector(df.where("not train"), names)))
    plain = -np.log(good[2000:][np.arange(1000), y[2000:]]).mean()
    assert own <= plain + 0.01 < climate
    weight = np.abs(model.coefficientMatrix.toArray())
    assert weight[:, :3].sum() > 5 * weight[:, 3:].sum()


def test_area_with_ties():
    rng = np.random.default_rng(4)
    s, y = np.round(rng.normal(size=80), 1), rng.integers(0, 2, 80)
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert np.isclose(experts.rank_auc(s, y), np.mean(pairs)) and np.isnan(experts.rank_auc(s, np.zeros(80)))


def test_stationary_bootstrap(spark):
    import hashlib

    n, rng = 60, np.random.default_rng(5)
    x = rng.normal(size=(n, 2))
    df = spark.createDataFrame([(dt.date(2000, 1, 1) + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(x)], "day date, a double, b double").repartition(4)
    got = {r.replicate: (r.n, r.a, r.b) for r in scoring.stationary_means(df, ["a", "b"], "day", 30, 7, 9).collect()}
    assert sorted(got) == list(range(30))
    jumps = 0
    for b in range(30):
        at, places = 0, []
        for t in range(n):
            h = hashlib.md5(f"9|{b}|{t}".encode()).hexdigest()
            u, v = ((int(h[i : i + 13], 16) + 0.5) / 2**52 for i in (0, 13))
            jump = t == 0 or u < 1 / 7
            jumps += jump
            at = int(v * n) if jump else (at + 1) % n
            places.append(at)
        assert got[b][0] == n and np.allclose(got[b][1:], x[places].mean(0))
    assert 0.1 < jumps / (30 * n) < 0.2


def test_confidence_set_in_spark(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3)) + [0.0, 0.0, 1.0]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "day long, m0 double, m1 double, m2 double")
    got = {r.model: r for r in scoring.confidence_and_superiority(df, ["m0", "m1", "m2"], "day", 200).collect()}
    assert got["m2"].mcs_p < 0.05 and max(got["m0"].mcs_p, got["m1"].mcs_p) == 1.0 and got["m0"].spa_p > 0.05
    swapped = scoring.confidence_and_superiority(df.select("day", F.col("m2").alias("m0"), "m1"), ["m0", "m1"], "day", 200).collect()
    assert swapped[0].spa_p < 0.05
