"""Properties of the operators: causality, invariants, known cases."""

import datetime as dt
import lzma
import math
import struct

import numpy as np
import pytest

from marketloom.functions import recursive as rec
from marketloom.functions import special
from marketloom.operators import bars, joins, quality, research, scoring
from marketloom.sources import readers


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def series(n=120, seed=1):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return c * (1 + rng.uniform(0, 0.01, n)), c * (1 - rng.uniform(0, 0.01, n)), c


def test_recursions_are_causal():
    h, low, c = series()
    cut = 80
    for f in (lambda h, l, c: rec.ema(c, 10), lambda h, l, c: rec.rsi(c), lambda h, l, c: rec.atr(h, l, c), lambda h, l, c: rec.macd(c)[2],
              lambda h, l, c: rec.directional(h, l, c)[0], lambda h, l, c: rec.supertrend(h, l, c)[0], lambda h, l, c: rec.adaptive_tail(np.diff(np.log(c)), 0.1, burn=30)[0][:cut - 1]):
        a, b = f(h, low, c)[: cut - 1], f(h[:cut], low[:cut], c[:cut])[: cut - 1]
        assert np.allclose(a, b, equal_nan=True, atol=1e-12)


def test_indicator_ranges():
    h, low, c = series(300)
    r = rec.rsi(c)
    assert np.nanmin(r) >= 0 and np.nanmax(r) <= 100 and np.isnan(r[:14]).all() and not np.isnan(r[14:]).any()
    adx, plus, minus = rec.directional(h, low, c)
    assert np.isnan(adx[:28]).all() and np.nanmin(adx) >= 0 and np.nanmax(adx) <= 100
    line, side = rec.supertrend(h, low, c)
    assert all((line[i] < c[i]) == (side[i] == 1) or abs(line[i] - c[i]) < 5 for i in range(20, 300))


def test_ewm_matches_definition():
    x = np.array([1.0, 3.0, 2.0, 5.0])
    want = [1.0]
    for v in x[1:]:
        want.append(0.5 * want[-1] + 0.5 * v)
    assert np.allclose(rec.ema(x, 3), want)


def test_delayed_mixture_uses_only_known_outcomes():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(3), (4, 60))
    y = rng.integers(0, 3, 60)
    base, _ = rec.share_experts(p, y, delay=5)
    other = y.copy()
    other[30] = (y[30] + 1) % 3
    changed, _ = rec.share_experts(p, other, delay=5)
    assert np.allclose(base[:35], changed[:35]) and not np.allclose(base[35:], changed[35:])
    assert np.allclose(base.sum(1), 1)


def test_adaptive_tail_reaches_its_rate():
    rng = np.random.default_rng(3)
    z = rng.standard_t(4, 3000) * np.where(np.arange(3000) > 1500, 2.0, 1.0)
    for respond in (None, rec.three_terms(0.05, 0.01, 0.001, 0.002, 0.98)):
        q, es, level = rec.adaptive_tail(z, 0.05, respond)
        ok = np.isfinite(q)
        assert abs((z[ok] <= q[ok]).mean() - 0.05) < 0.015
        assert (es[ok] <= q[ok] + 1e-12).all() and ((level[ok] > 0) & (level[ok] < 1)).all()


def test_special_functions():
    assert abs(special.normal_cdf(1.96) - 0.9750021) < 1e-6
    assert abs(float(special.t_cdf(2.0, 6.0)) - 0.953787) < 1e-5
    assert abs(special.t_quantile(0.005, 6.0) + 3.707428) < 1e-4
    assert abs(float(special.chi2_tail(3.841459, 1)) - 0.05) < 1e-6
    assert abs(float(special.chi2_tail(12.591587, 6)) - 0.05) < 1e-6
    assert abs(float(special.chi2_tail(7.814728, 3)) - 0.05) < 1e-6


def test_hidden_states_find_two_regimes():
    rng = np.random.default_rng(5)
    wild = (np.arange(1200) // 200) % 2 == 1
    x = rng.normal(0, np.where(wild, 3.0, 1.0))
    _, sd, trans, p = rec.hidden_states(x)
    assert sd[1] / sd[0] > 2 and trans[0, 0] > 0.9
    assert ((p[:, 1] > 0.5) == wild).mean() > 0.85


def test_step_down_controls_and_is_monotone():
    rng = np.random.default_rng(1)
    null = np.abs(rng.normal(size=(500, 8)))
    stat = np.array([5.0, 0.1, 0.5, 3.5, 0.2, 1.0, 0.3, 0.4])
    p = scoring.step_down(stat, null)
    assert p[0] < 0.01 and p[3] < 0.05 and p[1] > 0.3
    order = np.argsort(-stat)
    assert (np.diff(p[order]) >= 0).all()


def test_confidence_set_and_spa():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) + np.array([0.0, 0.0, 1.0])
    p = dict(scoring.confidence_set(x, ["a", "b", "c"]))
    assert p["c"] < 0.05 and max(p["a"], p["b"]) == 1.0
    assert scoring.superior_ability(x[:, 2:] - x[:, :2]) < 0.05
    assert scoring.superior_ability(x[:, :1] - x[:, 1:]) > 0.05


def test_realized_measures_identity(spark):
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i), 1.1 + 0.001 * math.sin(i)) for i in range(50)] + [("flat", dt.datetime(2024, 1, 1, i), 2.0) for i in range(10)]
    rows += [("short", dt.datetime(2024, 1, 1), 1.0), ("zero", dt.datetime(2024, 1, 1), 0.0), ("zero", dt.datetime(2024, 1, 1, 1), 1.0), ("zero", dt.datetime(2024, 1, 1, 2), 2.0)]
    got = {r.symbol: r for r in bars.realized(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")).collect()}
    assert abs(got["s"].rsp + got["s"].rsn - got["s"].rv) < 1e-15 and got["s"].n == 49
    assert got["flat"].rv == 0 and got["flat"].n == 9 and "short" not in got and got["zero"].n == 1


def test_thin_days_and_runs(spark):
    rows = [("s", day(i), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, n) for i, n in ((0, 200), (1, 10), (2, 150), (3, 20), (10, 200), (11, 5))]
    df = spark.createDataFrame(rows, "symbol string, day date, open double, high double, low double, close double, n long")
    got = {r.day: r for r in quality.merge_thin(df, "n", 100, ("n",)).collect()}
    assert sorted(got) == [day(0), day(2), day(10)]
    assert got[day(2)].open == 2.0 and got[day(2)].n == 160 and got[day(2)].folded == 1
    assert got[day(10)].folded == 0 and got[day(10)].n == 200
    assert [r.run for r in quality.runs(df).orderBy("day").collect()] == [1, 2, 3, 4, 1, 2]


@pytest.mark.parametrize("k,status", [(0, "block"), (5, "block"), (21, "block"), (22, "warn"), (36, "warn"), (37, "ok"), (120, "ok")])
def test_estimated_guard(spark, k, status):
    df = spark.createDataFrame([("s", day(i), int(i == 199 - k)) for i in range(200)], "symbol string, day date, flag int")
    row = quality.true_run(df, "flag").first()
    assert (row.true_rows, row.status) == (k, status)


def test_asof_against_loops(spark):
    rng = np.random.default_rng(4)
    left = [("ab"[i % 2], day(int(d))) for i, d in enumerate(rng.choice(60, 40, replace=False))]
    right = [("ab"[i % 2], day(int(d)), float(i)) for i, d in enumerate(rng.choice(60, 20, replace=False))]
    a, b = spark.createDataFrame(left, "symbol string, day date"), spark.createDataFrame(right, "symbol string, day date, v double")
    for strict in (False, True):
        for lag in (0, 1):
            got = {(r.symbol, r.day): r.v for r in joins.asof(a, b, "day", "v", strict=strict, lag=lag).collect()}
            for s, d in left:
                known = sorted((x, v) for t, x, v in right if t == s and (x < d if strict else x <= d))
                assert got[s, d] == (known[-1 - lag][1] if len(known) > lag else None)


def test_next_session_and_after_events(spark):
    sessions = spark.createDataFrame([(day(i),) for i in (0, 1, 2, 5, 6, 400)], "day date")
    events = spark.createDataFrame([(day(i),) for i in (-3, 0, 3, 6, 399, 400, 900)], "day date")
    got = {r.day: r.next_session for r in joins.next_after(events, sessions).collect()}
    assert got == {day(-3): day(0), day(0): day(1), day(3): day(5), day(6): day(400), day(399): day(400), day(400): None, day(900): None}
    after = {r.day: r.event_day for r in joins.sessions_after(events, sessions, 2).collect()}
    assert after == {day(0): day(-3), day(1): day(0), day(2): day(0), day(5): day(3), day(6): day(3), day(400): day(399)}


def test_priority_union_and_splice(spark):
    a = spark.createDataFrame([(day(0), 1.0), (day(2), 2.0)], "day date, close double")
    b = spark.createDataFrame([(day(0), 9.0), (day(1), 8.0)], "day date, close double")
    assert [tuple(r) for r in joins.priority_union(a, b, ["day"]).orderBy("day").collect()] == [(day(0), 1.0, "first"), (day(1), 8.0, "second"), (day(2), 2.0, "first")]
    assert [r.close for r in joins.splice(a, b, ["day"]).orderBy("day").collect()] == [1.0, 8.0, 2.0]


def test_minute_lines_and_time_zone(spark):
    from pyspark.sql import functions as F

    lines = ["20240102 093000;1.1;1.3;1.0;1.2;5", "2024.01.02,09:31,1.1,1.3,1.0,1.2,7", "EURUSD,20240102,093200,1.1,1.3,1.0,1.2,7", "EURUSD,20240102,093300,1.1,1.05,1.0,1.2,7", "junk", "x;y;z;1;2"]
    got = readers.parse_minutes(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("ts").collect()
    assert [r.ts.minute for r in got] == [30, 31, 32] and got[0].volume == 5
    t = spark.createDataFrame([(x,) for x in ("2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-07-01 12:00:00")], "s string")
    utc = [r.u for r in t.select(readers.to_utc(F.to_timestamp("s")).alias("u")).collect()]
    assert utc[0] is None and utc[1] is None and utc[2].hour == 16


def test_files(spark, tmp_path):
    rows = [(0, 110000, 110010, 109990, 110020, 2.5), (60, 110010, 110000, 109980, 110030, 0.0), (120, 110000, 110040, 110000, 110050, 1.0)]
    (tmp_path / "m.bi5").write_bytes(lzma.compress(b"".join(struct.pack(">5If", *r) for r in rows), format=lzma.FORMAT_ALONE))
    got = readers.minute_records(spark, str(tmp_path / "m.bi5")).orderBy("offset").collect()
    assert [(r.offset, r.open, r.high) for r in got] == [(0, 1.1, 1.1002), (120, 1.1, 1.1005)]
    (tmp_path / "a.csv").write_text("Date;o;h;l;c\n2024;1;2;3;4\n")
    assert readers.sniff_delimiter(spark, str(tmp_path / "a.csv")) == ";"
    (tmp_path / "b.csv").write_text("DATE,X\n2024-01-01,1.5\n2024-02-01,.\n")
    assert [tuple(r) for r in readers.observation_csv(spark, str(tmp_path / "b.csv")).collect()] == [(dt.date(2024, 1, 1), 1.5)]


def test_article_text(spark):
    from pyspark.sql import functions as F

    html = "<html><nav>no</nav><article><script>x()</script><p>One&amp;two</p>\n <style>z</style>three</article></html>"
    assert spark.createDataFrame([(html,)], "h string").select(readers.article_text(F.col("h"), 3).alias("t")).first().t == "One&two three"


def test_rules_against_loops(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    data = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 2, 400), rng.integers(0, 3, 400), rng.integers(0, 3, 400), strict=True)]
    df = spark.createDataFrame(data, "a int, b int, y int")
    got = {(r.rule, r.y): r for r in research.rules(df, {"a": F.col("a"), "b": F.col("b")}, "y", least=20).collect()}
    for a in (0, 1):
        for b in (0, 1, 2):
            rows = [y for i, j, y in data if i == a and j == b]
            r = got[f"a={a} & b={b}", 1]
            assert (r.n, r.hits) == (len(rows), rows.count(1))
    assert not any("a=0 & a=1" in k[0] for k in got)


def test_brute_auc(spark):
    rng = np.random.default_rng(8)
    rows = [(float(rng.integers(0, 12)), int(rng.random() < 0.4)) for _ in range(150)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(scoring.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first().auc - want) < 1e-12
