"""Rules behind four gates, on planted truth."""

import numpy as np
from pyspark.sql import functions as F

from marketloom.operators import gates, scoring


def test_rows_meet_their_conjunctions(spark):
    df = spark.createDataFrame([(1, 0, 2, None), (2, None, None, None), (3, 1, 1, 1)], "id long, b int, a int, c int")
    got = {}
    for r in gates.matches(df, {"b": F.col("b"), "a": F.col("a"), "c": F.col("c")}, ["id"]).collect():
        got.setdefault(r.id, set()).add(r.rule)
    assert got == {1: {"a=2", "b=0", "a=2 & b=0"}, 3: {"a=1", "b=1", "c=1", "a=1 & b=1", "a=1 & c=1", "b=1 & c=1"}}
    about = spark.createDataFrame([("a=1",), ("a=1 & b=2",), ("b=1 & b=2",)], "rule string").select("rule", gates.only_about(F.col("rule"), ("a",)).alias("x")).collect()
    assert [r.x for r in about] == [True, False, False]


def test_step_down_against_plain_code(spark):
    rng = np.random.default_rng(1)
    z, null = rng.normal(size=12) * 2, rng.normal(size=(60, 12))
    h = spark.createDataFrame([(f"r{i:02d}", float(v)) for i, v in enumerate(z)], "rule string, z double")
    n = spark.createDataFrame([(f"r{i:02d}", b, float(null[b, i])) for b in range(60) for i in range(12)], "rule string, draw int, z double").repartition(5)
    got = {r.rule: r.p for r in gates.step_down(h, n, ["rule"], 60).collect()}
    want = scoring.step_down(np.abs(z), np.abs(null))
    assert all(np.isclose(got[f"r{i:02d}"], want[i]) for i in range(12))


def planted(seed=3, n=3000):
    """good=1 lifts class 2 in every symbol and span; local=1 does in one symbol
    alone and not in others, early=1 in training alone; base=1 does as well but restates the base."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(3):
        for t in range(n):
            train = t < 2000
            good, local, early, base = rng.random(4) < 0.3
            p = np.array([1.0, 1.0, 1.0 + 0.9 * good + 0.9 * base + ((3.0 if s == 0 else -0.3) if local else 0.0) + ((1.2 if train else -0.3) if early else 0.0)])
            y = int(rng.choice(3, p=p / p.sum()))
            rows.append((f"s{s}", t, y, float(rng.normal()), bool(train), int(good), int(local), int(early), int(base)))
    return rows


def test_four_gates(spark):
    df = spark.createDataFrame(planted(), "symbol string, day long, y int, c double, train boolean, good int, local int, early int, base int").repartition(6)
    features = {k: F.when(F.col(k) == 1, 1) for k in ("good", "local", "early", "base")}
    out = {(r.rule, r.y): r for r in gates.four_gates(df, features, "y", "c", ("base",), draws=60).collect()}
    good, local, early, base = (out[f"{k}=1", 2] for k in ("good", "local", "early", "base"))
    assert good.passed == 4 and good.lift > 1.15 and good.p < 0.05 and good.t > 2 and good.everywhere
    assert base.passed == 1 and base.is_base and base.p < 0.05
    assert local.passed == 2 and not local.everywhere
    assert early.passed == 3 and early.z_later < 1
    rows = [r for r in planted() if r[4]]
    hit = [r for r in rows if r[5] == 1]
    share = np.mean([r[2] == 2 for r in rows])
    own = np.mean([r[2] == 2 for r in hit])
    assert good.n == len(hit) and np.isclose(good.lift, own / share) and np.isclose(good.z, (own - share) / np.sqrt(share * (1 - share) / len(hit)))
    x = np.array([[1.0, r[5] == 1, r[3]] for r in rows], float)
    y = np.array([r[2] == 2 for r in rows], float)
    b, ssr, *_ = np.linalg.lstsq(x, y, rcond=None)
    se = np.sqrt(ssr[0] / (len(y) - 3) * np.linalg.inv(x.T @ x)[1, 1])
    assert np.isclose(good.t, b[1] / se)


def test_a_rule_that_the_control_explains(spark):
    rows = [(f"s{i % 2}", i, i // 2 % 3, float(i // 2 % 2), True, i // 2 % 2) for i in range(800)]
    df = spark.createDataFrame(rows, "symbol string, day long, y int, c double, train boolean, same int")
    out = gates.four_gates(df, {"same": F.col("same")}, "y", "c", (), draws=20).collect()
    assert out and all(r.t is None and r.z_later is None and r.passed <= 1 for r in out)
