"""Data quality of bar tables: validity, gaps, runs, thin days, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_symbol(ts: str = "day"):
    return Window.partitionBy("symbol").orderBy(ts)


def invalid(eps: float = 1e-9) -> Column:
    return (F.col("high") < F.greatest("open", "close") - eps) | (F.col("low") > F.least("open", "close") + eps) | (F.col("high") < F.col("low") - eps)


def validity(df: DataFrame, ts: str = "day") -> DataFrame:
    """Invalid bars and repeated timestamps per symbol."""
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(invalid()).alias("n_invalid"), F.count_if(F.col("high") == F.col("low")).alias("n_flat"),
        (F.count(F.lit(1)) - F.count_distinct(ts)).alias("n_repeated"),
    )


def gaps(df: DataFrame, ts: str = "day") -> DataFrame:
    """Histogram of calendar gaps between rows per symbol."""
    g = F.datediff(ts, F.lag(ts).over(by_symbol(ts)))
    rows = df.withColumn("gap", g)
    return rows.groupBy("symbol").agg(
        *[F.count_if(F.col("gap") == k).alias(f"gap{k}") for k in (1, 2, 3)], F.count_if(F.col("gap").between(4, 7)).alias("gap4_7"),
        F.count_if(F.col("gap") > 7).alias("gap_more"), F.max("gap").alias("longest"), F.max_by(ts, F.struct("gap", ts)).alias("longest_to"),
    )


def runs(df: DataFrame, most: int = 4, ts: str = "day") -> DataFrame:
    """run: rows since the last gap of more than `most` days, the row included."""
    broken = F.coalesce((F.datediff(ts, F.lag(ts).over(by_symbol(ts))) > most).cast("int"), F.lit(0))
    rows = df.withColumn("island", F.sum(broken).over(by_symbol(ts)))
    return rows.withColumn("run", F.row_number().over(Window.partitionBy("symbol", "island").orderBy(ts)))


def merge_thin(df: DataFrame, size: str, least: float, sums: tuple[str, ...], most_days: int = 3, ts: str = "day") -> DataFrame:
    """Fold a thin day into the next day if that is not thin and at most
    most_days later (open of the thin day, highest high, lowest low, sums
    added); other thin days are dropped."""
    w = by_symbol(ts)
    thin = F.col(size) < least
    rows = df.withColumn("prior", F.lag(F.struct(*df.columns)).over(w))
    folds = F.coalesce((F.col(f"prior.{size}") < least) & (F.datediff(ts, f"prior.{ts}") <= most_days), F.lit(False))
    made = {
        "open": F.when(folds, F.col("prior.open")).otherwise(F.col("open")), "high": F.when(folds, F.greatest("high", "prior.high")).otherwise(F.col("high")),
        "low": F.when(folds, F.least("low", "prior.low")).otherwise(F.col("low")),
    } | {c: F.when(folds, F.col(c) + F.col(f"prior.{c}")).otherwise(F.col(c)) for c in sums}
    return rows.where(~thin).withColumn("folded", folds.cast("int")).withColumns(made).drop("prior")


def patch_from_cross(df: DataFrame, a: DataFrame, b: DataFrame, ts: str = "day") -> DataFrame:
    """Missing rows of df inside its own range, from the product of two series."""
    span = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    cross = a.alias("a").join(b.alias("b"), ts)
    prod = cross.select(ts, *[(F.col(f"a.{c}") * F.col(f"b.{c}")).alias(c) for c in ("open", "close")])
    prod = prod.withColumns({"high": F.greatest("open", "close"), "low": F.least("open", "close"), "is_patched": F.lit(1)})
    new = prod.join(F.broadcast(span)).where(F.col(ts).between(F.col("lo"), F.col("hi"))).drop("lo", "hi").join(df.select(ts), ts, "left_anti")
    return df.select(ts, "open", "close", "high", "low").withColumn("is_patched", F.lit(0)).unionByName(new)


def split_label(ts: str, valid_from: str, test_from: str) -> Column:
    """0 train, 1 valid, 2 test."""
    return F.when(F.col(ts) < F.lit(valid_from).cast("date"), 0).when(F.col(ts) < F.lit(test_from).cast("date"), 1).otherwise(2)


def true_run(df: DataFrame, flag: str, window: int = 22, spare: int = 15, ts: str = "day") -> DataFrame:
    """Rows since the last flagged (estimated) one, and whether to block (a
    flagged row in the last `window`) or warn (in the last window + spare)."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col(ts).desc()))
    rows = df.withColumn("back", back)
    n = F.coalesce(F.min(F.when(F.col(flag) == 1, F.col("back"))) - 1, F.count(F.lit(1)))
    out = rows.groupBy("symbol").agg(n.cast("long").alias("true_rows"))
    return out.withColumn("status", F.when(F.col("true_rows") < window, "block").when(F.col("true_rows") < window + spare, "warn").otherwise("ok"))


def freshness(new: DataFrame, old: DataFrame, least: int = 5, ts: str = "day") -> DataFrame:
    """Per symbol: whether the new snapshot ends no earlier and has enough rows."""
    n = new.groupBy("symbol").agg(F.max(ts).alias("new_end"), F.count(F.lit(1)).alias("rows"))
    o = old.groupBy("symbol").agg(F.max(ts).alias("old_end"))
    fresh = (F.col("rows") >= least) & (F.col("old_end").isNull() | (F.col("new_end") >= F.col("old_end")))
    return o.join(n, "symbol", "full").withColumn("fresh", F.coalesce(fresh, F.lit(False)))


def range_against_before(df: DataFrame, n: int = 250, ts: str = "day") -> DataFrame:
    """A bar's relative range over the mean of the n bars before."""
    w = by_symbol(ts).rowsBetween(-n, -1)
    size = (F.col("high") - F.col("low")) / F.col("close")
    rows = df.withColumn("size", size)
    return rows.withColumn("ratio", F.when(F.count("size").over(w) == n, F.try_divide(F.col("size"), F.avg("size").over(w))))


def anomalies(df: DataFrame, value: str, limit: float, events: DataFrame, before: int = 1, after: int = 1, ts: str = "day") -> DataFrame:
    """Rows with |value| above the limit, with the codes of events within days around."""
    rows = df.where(F.abs(value) > limit).select("symbol", ts, value)
    e = events.select(F.col("day").alias("event_day"), "code").withColumn(ts, F.explode(F.sequence(F.date_sub("event_day", before), F.date_add("event_day", after))))
    # The range join is an equi-join on the days around an event.
    out = rows.join(e, ts, "left").groupBy("symbol", ts, value).agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))
    return out


def pip_size(symbol: str = "symbol") -> Column:
    return F.when(F.col(symbol).contains("JPY"), 0.01).otherwise(0.0001)


def next_session(ts: str) -> Column:
    """The next weekday."""
    d = F.dayofweek(ts)
    return F.date_add(ts, F.when(d == 6, 3).when(d == 7, 2).otherwise(1))
