"""Models of several series together: grids of forecast configurations, spillovers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators import forecast, gram, scoring

#: Regressors of a configuration; the last two are its choices.
DESIGN = ["x", "lw", "lm", "others", "event"]
CHOICE = ["deseason", "span", "others_in", "event_in", "shrink"]


def _fits(least: int, ridge: float):
    """Coefficients of the four designs with and without the last two regressors, 0 for those left out."""
    size = len(DESIGN) + 2

    @F.pandas_udf("array<array<double>>")
    def fit(rows: pd.Series) -> pd.Series:
        m = gram.unpacked(rows, size)
        good = m[:, 0, 0] >= least
        out = np.empty(len(m), object)
        made = np.zeros((int(good.sum()), 4, size - 1))
        for choice in range(4):
            at = [0, 1, 2, 3, *([4] if choice % 2 else []), *([5] if choice // 2 else [])]
            made[:, choice, at] = gram.solve(m[good][:, at][:, :, at] + ridge * np.eye(len(at)), m[good][:, at, -1][:, :, None])[:, :, 0]
        for i, v in zip(np.flatnonzero(good), made, strict=True):
            out[i] = v.tolist()
        return pd.Series(out)

    return fit


def forecast_grid(df: DataFrame, spans: tuple[int, ...] = (0, 500), weights: tuple[float, ...] = (0.0, 0.5), max_gap: int = 4, least: int = 60, ridge: float = forecast.RIDGE) -> DataFrame:
    """deseason, span, others_in, event_in, shrink, recalibrated, symbol -> n, loss.

    df: symbol, day, lv (log variance), factor (its weekday's) and event (0 or 1,
    of the day).  Every configuration forecasts the next session's log variance
    from the rows before: with or without the weekday factor taken out, over all
    rows or the last `span`, with or without the mean of the other symbols and
    the next session's event, coefficients drawn towards the panel's mean by
    `shrink`, recalibrated by the past regression on outcomes or not.  A forecast
    goes to the next session only within max_gap days.  loss is the mean of
    exp(y - f) - (y - f) - 1, f with half the variance of past errors.

    The sums of products of the whole design are made once for each row, as
    running sums; a window's are their differences, a design's are some of their
    cells.  So all configurations are columns and rows of one plan.
    """
    by = Window.partitionBy("symbol").orderBy("day")
    lead = lambda c: F.lead(c).over(by)
    plain = F.struct(F.lit(0).alias("deseason"), F.col("lv").alias("x"), lead("lv").alias("y"), F.lit(0.0).alias("back"))
    level = F.col("lv") - F.col("factor")
    cleared = F.struct(F.lit(1).alias("deseason"), level.alias("x"), (lead("lv") - lead("factor")).alias("y"), lead("factor").alias("back"))
    rows = df.withColumns({"gap": F.datediff(lead("day"), "day"), "next": lead("event").cast("double"), "two": F.array(plain, cleared)})
    rows = rows.select("symbol", "day", "gap", F.col("next").alias("event"), F.explode("two").alias("v")).select("symbol", "day", "gap", "event", "v.*")

    own = Window.partitionBy("deseason", "symbol").orderBy("day")
    mean = lambda n: F.when(F.count("x").over(own.rowsBetween(1 - n, 0)) == n, F.avg("x").over(own.rowsBetween(1 - n, 0)))
    day = Window.partitionBy("deseason", "day")
    rows = rows.withColumns({"lw": mean(5), "lm": mean(22), "others": F.when(F.count("x").over(day) > 1, (F.sum("x").over(day) - F.col("x")) / (F.count("x").over(day) - 1))})
    values = [F.lit(1.0), *[F.col(c) for c in [*DESIGN, "y"]]]
    ok, past = gram.known([*DESIGN, "y"]), own.rowsBetween(Window.unboundedPreceding, -1)
    cells = gram.cells(len(values))
    rows = rows.withColumns({f"m{i}_{j}": F.coalesce(F.sum(F.when(ok, values[i] * values[j])).over(past), F.lit(0.0)) for i, j in cells})
    since = lambda c, n: F.col(c) - (F.coalesce(F.lag(c, n).over(own), F.lit(0.0)) if n else F.lit(0.0))
    sums = [F.struct(F.lit(n).alias("span"), F.array(*[since(c, n) for c in gram.cell_names(len(values))]).alias("sums")) for n in spans]
    rows = rows.withColumn("spans", F.array(*sums)).drop(*gram.cell_names(len(values)))
    rows = rows.select("*", F.explode("spans").alias("s")).select(*[c for c in rows.columns if c != "spans"], "s.span", _fits(least, ridge)("s.sums").alias("betas")).where("betas is not null")
    rows = rows.select("*", F.posexplode("betas").alias("choice", "beta")).drop("betas").withColumns({"others_in": F.col("choice") % 2, "event_in": F.floor(F.col("choice") / 2).cast("int")})

    panel = Window.partitionBy("deseason", "span", "choice", "day")
    size = len(DESIGN) + 1
    means = F.array(*[F.avg(F.col("beta")[i]).over(panel) for i in range(size)])
    rows = rows.withColumn("mean", means).withColumn("shrink", F.explode(F.array(*[F.lit(w) for w in weights])))
    drawn = lambda i: (1 - F.col("shrink")) * F.col("beta")[i] + F.col("shrink") * F.col("mean")[i]
    g = drawn(0)
    inside = {"others": F.col("others_in") == 1, "event": F.col("event_in") == 1}
    for i, c in enumerate(DESIGN):  # a regressor left out may be unknown
        g = g + (F.when(inside[c], drawn(i + 1) * F.col(c)).otherwise(0.0) if c in inside else drawn(i + 1) * F.col(c))
    rows = rows.select(*CHOICE, "symbol", "day", "gap", "y", "back", g.alias("g"))
    run = Window.partitionBy(*CHOICE, "symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    both = F.col("g").isNotNull() & F.col("y").isNotNull()
    rows = rows.withColumns({
        "n": F.count(F.when(both, 1)).over(run), "slope": F.regr_slope("y", "g").over(run), "intercept": F.regr_intercept("y", "g").over(run), "s2": F.var_samp(F.col("y") - F.col("g")).over(run),
    }).where(both & F.col("back").isNotNull() & (F.col("gap") <= max_gap) & (F.col("n") >= 30))
    made = F.array(F.struct(F.lit(0).alias("recalibrated"), F.col("g").alias("f")), F.struct(F.lit(1).alias("recalibrated"), (F.col("intercept") + F.col("slope") * F.col("g")).alias("f")))
    rows = rows.select(*CHOICE, "symbol", (F.col("y") + F.col("back")).alias("y"), "back", "s2", F.explode(made).alias("m"))
    f = F.col("m.f") + F.col("back") + 0.5 * F.col("s2")
    return rows.groupBy(*CHOICE, F.col("m.recalibrated").alias("recalibrated"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(scoring.qlike_ratio(F.exp(f), F.exp("y"))).alias("loss"))


def spillover(df: DataFrame, block: Column, value: str = "lv", symbol: str = "symbol", ts: str = "day", steps: int = 10, most_series: int = 200) -> DataFrame:
    """block, to, from, share: what part of a series' forecast error variance
    each series' shocks make, by a VAR(1) of all rows before the block.

    block is an expression of the common day (ts) and its place k; products of
    neighbouring days are summed by block and then over the blocks before, so a
    refit costs one small solve, however long the history.
    """
    names = sorted(r[0] for r in df.where(F.col(value).isNotNull()).select(symbol).distinct().limit(most_series + 1).collect())
    if len(names) > most_series:
        raise ValueError(f"more than {most_series} series")
    m = len(names)
    at = lambda i: F.max(F.when(F.col(symbol) == names[i], F.col(value)))
    now, lag = [f"v{i}" for i in range(m)], [f"l{i}" for i in range(m)]
    days = df.groupBy(ts).agg(*[at(i).alias(now[i]) for i in range(m)])
    order = Window.orderBy(ts)  # a row for each common day
    whole = days.dropna(subset=now).withColumn("k", F.row_number().over(order) - 1)
    rows = whole.withColumns({lag[i]: F.lag(now[i]).over(order) for i in range(m)}).withColumn("block", block)
    size = 2 * m + 1
    sums = days.select(ts).withColumn("k", F.lit(None).cast("int")).select(block.alias("block")).unionByName(rows.select("block")).where("block is not null").distinct()
    sums = sums.join(gram.moments(rows, ["block"], [*lag, *now]), "block", "left").fillna(0.0, gram.cell_names(size))
    sums = gram.before_own(sums, [], "block", size).where(F.col("m0_0") + 1 >= 2 * (m + 1))

    @F.pandas_udf("array<double>")
    def shares(rows: pd.Series) -> pd.Series:
        out = []
        for a in gram.unpacked(rows, size):
            z, zy, yy = a[: m + 1, : m + 1], a[: m + 1, m + 1 :], a[m + 1 :, m + 1 :]
            b = np.linalg.solve(z + forecast.RIDGE * np.eye(m + 1), zy)
            s = (yy - zy.T @ b - b.T @ zy + b.T @ z @ b) / a[0, 0]
            step, num, den = np.eye(m), np.zeros((m, m)), np.zeros(m)
            for _ in range(steps):
                num += (step @ s) ** 2 / np.diag(s)
                den += np.diag(step @ s @ step.T)
                step = b[1:].T @ step
            share = num / den[:, None]
            out.append((share / share.sum(1, keepdims=True)).ravel().tolist())
        return pd.Series(out, dtype=object)

    labels = F.array(*[F.lit(x) for x in names])
    found = sums.select("block", F.posexplode(shares(gram.packed(size))).alias("at", "share"))
    return found.select("block", labels[F.floor(F.col("at") / m).cast("int")].alias("to"), labels[F.col("at") % m].alias("from"), "share")
