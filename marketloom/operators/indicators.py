"""Technical indicators.  Window expressions where the definition allows;
recursions run once per symbol in Arrow batches (applyInPandas)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import recursive as rec

EPS = 1e-12


def w(ts: str = "day"):
    return Window.partitionBy("symbol").orderBy(ts)


def over(n: int, ts: str = "day"):
    return w(ts).rowsBetween(-(n - 1), 0)


def full(agg: Callable[..., Column], value: str, n: int, ts: str = "day") -> Column:
    """A rolling aggregate, null until n rows are there."""
    return F.when(F.count(value).over(over(n, ts)) == n, agg(value).over(over(n, ts)))


def per_symbol(df: DataFrame, columns: list[str], made: dict[str, str], f: Callable[..., dict[str, np.ndarray]], ts: str = "day") -> DataFrame:
    """f(arrays of columns) along each symbol in order; made: new column -> type.

    One task holds one symbol's columns, as each step needs the one before.
    """
    schema = ", ".join([f"symbol {dict(df.dtypes)['symbol']}", f"{ts} {dict(df.dtypes)[ts]}", *[f"{c} {t}" for c, t in made.items()]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        out = f(*[pdf[c].to_numpy(float) for c in columns])
        made_rows = pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), ts: pdf[ts].to_numpy(), **out})
        return made_rows.astype({c: "Int64" for c, t in made.items() if t in ("int", "long")})

    return df.select("symbol", ts, *columns).groupBy("symbol").applyInPandas(run, schema)


def rsi_macd_atr(df: DataFrame, ts: str = "day") -> DataFrame:
    """ema20, rsi14, atr14, macd, signal and histogram."""

    def f(h, low, c):
        line, signal, rest = rec.macd(c)
        return {"ema20": rec.ema(c, 20), "rsi14": rec.rsi(c), "atr14": rec.atr(h, low, c), "macd": line, "macd_signal": signal, "macd_rest": rest}

    return per_symbol(df, ["high", "low", "close"], dict.fromkeys(("ema20", "rsi14", "atr14", "macd", "macd_signal", "macd_rest"), "double"), f, ts)


def trend(df: DataFrame, ts: str = "day") -> DataFrame:
    """supertrend line and side, ADX, DI+, DI-, Keltner channel."""

    def f(h, low, c):
        line, side = rec.supertrend(h, low, c)
        strength, plus, minus = rec.directional(h, low, c)
        mid, bottom, top = rec.keltner(h, low, c)
        return {"supertrend": line, "side": side, "adx": strength, "di_plus": plus, "di_minus": minus, "keltner_mid": mid, "keltner_low": bottom, "keltner_high": top}

    made = dict.fromkeys(("supertrend", "side", "adx", "di_plus", "di_minus", "keltner_mid", "keltner_low", "keltner_high"), "double") | {"side": "int"}
    return per_symbol(df, ["high", "low", "close"], made, f, ts)


def true_range() -> Column:
    before = F.lag("close").over(w())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def channels(df: DataFrame, ts: str = "day") -> DataFrame:
    """SMA 20, Bollinger 20 (population deviation), Donchian 20, stochastic 14, Ichimoku 9/26/52."""
    sma, sd = full(F.avg, "close", 20, ts), full(F.stddev_pop, "close", 20, ts)
    hi, lo = (lambda n: full(F.max, "high", n, ts)), (lambda n: full(F.min, "low", n, ts))
    rows = df.withColumns({"tr": true_range(), "sma20": sma, "boll_low": sma - 2 * sd, "boll_high": sma + 2 * sd, "don_low": lo(20), "don_high": hi(20),
                           "stoch_k": 100 * (F.col("close") - lo(14)) / F.greatest(hi(14) - lo(14), F.lit(EPS)),
                           "tenkan": (hi(9) + lo(9)) / 2, "kijun": (hi(26) + lo(26)) / 2, "span_b": (hi(52) + lo(52)) / 2})
    rows = rows.withColumns({"stoch_d": full(F.avg, "stoch_k", 3, ts), "span_a": (F.col("tenkan") + F.col("kijun")) / 2})
    return rows


def percentile_rank(df: DataFrame, value: str, n: int, least: int, ts: str = "day") -> DataFrame:
    """Share of the last n values below the row's own, ties counting half and the
    row itself as a tie; null until `least` values are there."""
    held = F.collect_list(value).over(over(n, ts))
    rows = df.withColumn("__held", held)
    v = F.col(value)
    rank = (F.size(F.filter("__held", lambda x: x < v)) + (F.size(F.filter("__held", lambda x: x == v)) + 1) / 2) / F.size("__held")
    return rows.withColumn("pct_rank", F.when((F.size("__held") >= least) & v.isNotNull(), rank)).drop("__held")


def vwap(df: DataFrame, n: int, volume: str = "volume", ts: str = "day") -> DataFrame:
    mid = (F.col("high") + F.col("low") + F.col("close")) / 3
    rows = df.withColumn("__m", mid * F.col(volume))
    return rows.withColumn("vwap", F.try_divide(full(F.sum, "__m", n, ts), full(F.sum, volume, n, ts))).drop("__m")


def pivots(df: DataFrame, k: int = 2, ts: str = "day") -> DataFrame:
    """swing_high / swing_low: 1 where the extreme is the only one within k rows
    on both sides; known k rows later."""
    around = w(ts).rowsBetween(-k, k)
    inside = F.count(F.lit(1)).over(around) == 2 * k + 1
    rows = df.withColumns({"__h": F.collect_list("high").over(around), "__l": F.collect_list("low").over(around)})
    one = lambda held, v, best: (v == best(held)) & (F.size(F.filter(held, lambda x: x == v)) == 1)
    return rows.withColumns({"swing_high": (inside & one(F.col("__h"), F.col("high"), F.array_max)).cast("int"), "swing_low": (inside & one(F.col("__l"), F.col("low"), F.array_min)).cast("int")}).drop("__h", "__l")


def levels(df: DataFrame, k: int = 2, tolerance: float = 0.0015, most: int = 6, ts: str = "day") -> DataFrame:
    """Support and resistance levels of each symbol: rank, level, touches, last."""
    p = pivots(df, k, ts)
    hit = p.select("symbol", ts, F.explode(F.array(F.struct(F.col("swing_high").alias("on"), F.col("high").alias("p"), F.lit(1).alias("kind")), F.struct(F.col("swing_low").alias("on"), F.col("low").alias("p"), F.lit(-1).alias("kind")))).alias("x"))
    hit = hit.where("x.on = 1").select("symbol", F.unix_date(ts).cast("long").alias("t"), "x.p", "x.kind")

    # Hits in order of time, then price.  A hit joins the first level it is near
    # to, whose mean it moves, or opens a level; so the order of levels matters
    # and they are one array for each symbol.
    hits = hit.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("t", "p"))).alias("hits"))
    none = F.array().cast("array<struct<level:double,touches:bigint,last:bigint>>")

    def joined(held: Column, x: Column) -> Column:
        near = F.transform(held, lambda l: F.abs(l["level"] - x["p"]) <= tolerance * F.greatest(x["p"], F.lit(EPS)))
        at = F.array_position(near, True)
        moved = lambda l, i: F.when(i + 1 == at, F.struct(((l["level"] * l["touches"] + x["p"]) / (l["touches"] + 1)).alias("level"), (l["touches"] + 1).alias("touches"), x["t"].alias("last"))).otherwise(l)
        opened = F.array(F.struct(x["p"].alias("level"), F.lit(1).cast("long").alias("touches"), x["t"].alias("last")))
        return F.when(at > 0, F.transform(held, moved)).otherwise(F.concat(held, opened))

    found = hits.select("symbol", F.explode(F.aggregate("hits", none, joined)).alias("l")).select("symbol", "l.*")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("touches").desc(), F.col("last").desc(), "level"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("symbol", "rank", "level", "touches", "last")


def open_gaps(df: DataFrame, most: int = 12, ts: str = "day") -> DataFrame:
    """Three-bar price gaps that later bars haven't closed, the last `most` per symbol."""
    later = w(ts).rowsBetween(2, Window.unboundedFollowing)
    rows = df.withColumns({"h0": F.lag("high").over(w(ts)), "l0": F.lag("low").over(w(ts)), "h2": F.lead("high").over(w(ts)), "l2": F.lead("low").over(w(ts)),
                           "low_later": F.min("low").over(later), "high_later": F.max("high").over(later)})
    up, down = F.col("l2") > F.col("h0"), F.col("h2") < F.col("l0")
    rows = rows.withColumns({"side": F.when(up, 1).when(down, -1), "bottom": F.when(up, F.col("h0")).otherwise(F.col("h2")), "top": F.when(up, F.col("l2")).otherwise(F.col("l0"))})
    closed = F.when(F.col("side") == 1, F.col("low_later") <= F.col("bottom")).otherwise(F.col("high_later") >= F.col("top"))
    rows = rows.where(F.col("side").isNotNull() & ~F.coalesce(closed, F.lit(False)))
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col(ts).desc()))
    return rows.withColumn("k", last).where(F.col("k") <= most).select("symbol", ts, "side", "bottom", "top")


def sweeps(df: DataFrame, k: int = 2, back: int = 60, ts: str = "day") -> DataFrame:
    """Bars whose wick passes the highest (lowest) swing of the last rows that
    was known, and whose close is back inside."""
    p = pivots(df, k, ts)
    seen = w(ts).rowsBetween(-back, -k - 1)
    p = p.withColumns({"top": F.max(F.when(F.col("swing_high") == 1, F.col("high"))).over(seen), "bottom": F.min(F.when(F.col("swing_low") == 1, F.col("low"))).over(seen)})
    high = p.where("high > top and close < top").select("symbol", ts, F.col("top").alias("level"), F.lit(-1).alias("side"))
    return high.unionByName(p.where("low < bottom and close > bottom").select("symbol", ts, F.col("bottom").alias("level"), F.lit(1).alias("side")))


def candles(df: DataFrame, ts: str = "day") -> DataFrame:
    """Shares of body and wicks, and named patterns of one to three bars."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    p = {x: F.lag(x).over(w(ts)) for x in ("open", "high", "low", "close")}
    pp = {x: F.lag(x, 2).over(w(ts)) for x in ("open", "close")}
    span, body = F.greatest(h - low, F.lit(EPS)), F.abs(c - o)
    upper, lower = h - F.greatest(o, c), F.least(o, c) - low
    up, down = c > o, c < o
    was_up, was_down = p["close"] > p["open"], p["close"] < p["open"]
    before = F.abs(p["close"] - p["open"])
    inside = (F.greatest(o, c) <= F.greatest(p["open"], p["close"])) & (F.least(o, c) >= F.least(p["open"], p["close"])) & (body < before)
    flag = {
        "doji": body <= 0.1 * span, "marubozu": body >= 0.9 * span, "hammer": (lower >= 2 * body) & (upper <= body) & (body > 0), "shooting_star": (upper >= 2 * body) & (lower <= body) & (body > 0),
        "engulfing_up": up & was_down & (c >= p["open"]) & (o <= p["close"]), "engulfing_down": down & was_up & (c <= p["open"]) & (o >= p["close"]),
        "harami_up": up & was_down & inside, "harami_down": down & was_up & inside,
        "inside_bar": (h <= p["high"]) & (low >= p["low"]), "outside_bar": (h >= p["high"]) & (low <= p["low"]),
        "three_up": up & was_up & (pp["close"] > pp["open"]), "three_down": down & was_down & (pp["close"] < pp["open"]),
        "gap_up": low > p["high"], "gap_down": h < p["low"],
    }
    return df.withColumns({"body": body / span, "upper": upper / span, "lower": lower / span, "close_at": (c - low) / span} | {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in flag.items()})


def momentum(df: DataFrame, n: int, ts: str = "day") -> DataFrame:
    r = F.ln("close") - F.ln(F.lag("close").over(w(ts)))
    rows = df.withColumn("r", r)
    return rows.withColumn("tsmom", full(F.sum, "r", n, ts)).withColumn("side", F.signum("tsmom").cast("int"))


def autocorrelation(df: DataFrame, value: str, n: int, ts: str = "day") -> DataFrame:
    """Lag-one correlation of the last n values."""
    rows = df.withColumn("__before", F.lag(value).over(w(ts)))
    pair = over(n - 1, ts)
    ok = F.count(F.when(F.col("__before").isNotNull() & F.col(value).isNotNull(), 1)).over(pair) == n - 1
    return rows.withColumn("autocorr", F.when(ok, F.corr(value, "__before").over(pair))).drop("__before")
