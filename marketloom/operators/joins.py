"""As-of, range and calendar joins, and unions by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, value: str, keys: tuple[str, ...] = ("symbol",), strict: bool = False, lag: int = 0) -> DataFrame:
    """left with the latest value of right at or before (strict: before) each row.

    Both sides are merged into one ordered stream per key: one shuffle, no
    pairs.  lag: take the value that many right rows earlier.
    """
    w = Window.partitionBy(*keys).orderBy(on)
    right = right.select(*keys, on, (F.lag(value, lag).over(w) if lag else F.col(value)).alias("__v"), F.lit(0).alias("__side"))
    cols = left.columns
    both = left.select("*", F.lit(None).cast(right.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__side")).unionByName(right, allowMissingColumns=True)
    order = [F.col(on), F.col("__side").desc() if strict else F.col("__side")]
    seen = F.last("__v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, seen).where("__side = 1").select(*[c for c in cols if c != value], value)


def forward_fill(df: DataFrame, value: str, limit: int, keys: tuple[str, ...] = ("symbol",), ts: str = "day") -> DataFrame:
    """Nulls filled with the last value at most `limit` rows before."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-limit, 0)
    return df.withColumn(f"{value}_filled", F.last(value, ignorenulls=True).over(w))


def next_after(left: DataFrame, sessions: DataFrame, on: str = "day") -> DataFrame:
    """left with the first session strictly after its day."""
    s = sessions.select(F.col(on).alias("__s")).distinct().select(F.col("__s").alias(on), F.col("__s"), F.lit(0).alias("__side"))
    rows = left.withColumns({"__s": F.lit(None).cast("date"), "__side": F.lit(1)})
    both = rows.unionByName(s, allowMissingColumns=True).withColumn("__block", F.trunc(on, "year"))
    # Blocks of years keep the ordering parallel; a block without a later
    # session takes the first of the blocks after it.
    w = Window.partitionBy("__block").orderBy(F.col(on), F.col("__side").asc()).rowsBetween(1, Window.unboundedFollowing)
    firsts = s.groupBy(F.trunc(on, "year").alias("__b")).agg(F.min("__s").alias("__f"))
    later = firsts.withColumn("__next", F.min("__f").over(Window.orderBy("__b").rowsBetween(1, Window.unboundedFollowing)))  # a row per year
    out = both.withColumn("__n", F.first("__s", ignorenulls=True).over(w)).where("__side = 1")
    years = left.select(F.trunc(on, "year").alias("__b")).distinct().join(firsts.select("__b"), "__b", "left_anti")
    gap = years.join(F.broadcast(firsts.withColumnRenamed("__b", "__c")), F.col("__c") > F.col("__b")).groupBy("__b").agg(F.min("__f").alias("__next"))
    later = later.select("__b", "__next").unionByName(gap)
    out = out.join(F.broadcast(later), F.col("__block") == F.col("__b"), "left")
    return out.select(*left.columns, F.coalesce("__n", "__next").alias("next_session"))


def sessions_after(events: DataFrame, sessions: DataFrame, k: int, on: str = "day") -> DataFrame:
    """Each session within the k sessions strictly after an event, with the latest such event."""
    place = F.row_number().over(Window.orderBy(on))  # one row per calendar day
    s = sessions.select(on).distinct().withColumn("place", place)
    e = next_after(events.select(F.col(on)).distinct(), sessions, on).withColumnRenamed(on, "event_day")
    e = e.join(s.select(F.col(on).alias("next_session"), "place"), "next_session")
    e = e.withColumn("place", F.explode(F.sequence(F.col("place"), F.col("place") + (k - 1)))).groupBy("place").agg(F.max("event_day").alias("event_day"))
    return s.join(e, "place").select(on, "event_day")


def common_days(df: DataFrame, ts: str = "day") -> DataFrame:
    """Rows on the days that all symbols have."""
    total = df.select("symbol").distinct().agg(F.count(F.lit(1)).alias("k"))
    days = df.groupBy(ts).agg(F.count_distinct("symbol").alias("k")).join(F.broadcast(total), "k").select(ts)
    return df.join(days, ts, "left_semi")


def with_month_lag(df: DataFrame, monthly: DataFrame, months: int, ts: str = "day") -> DataFrame:
    """Rows with the monthly value that was out: the one of `months` months before."""
    m = monthly.withColumn("month", F.add_months("month", months).cast("date"))
    return df.withColumn("month", F.trunc(ts, "month")).join(m, "month", "left")


def known_at(df: DataFrame, at: str, value: str, keys: list[str], available: str = "available_time") -> DataFrame:
    """Of bitemporal rows, the latest revision that was available at a time."""
    rows = df.where(F.col(available) <= F.lit(at).cast("timestamp"))
    return rows.groupBy(*keys).agg(F.max_by(value, available).alias(value))


def priority_union(first: DataFrame, second: DataFrame, keys: list[str], names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """All rows of first, and those of second whose keys first lacks; source says which."""
    rest = second.join(first.select(*keys), keys, "left_anti")
    return first.withColumn("source", F.lit(names[0])).unionByName(rest.withColumn("source", F.lit(names[1])), allowMissingColumns=True)


def splice(history: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """history, continued by live; a key in both keeps the history row."""
    both = history.withColumn("__p", F.lit(0)).unionByName(live.withColumn("__p", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("__p"))
    return both.withColumn("__n", first).where("__n = 1").drop("__n", "__p")


def densify(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "day") -> DataFrame:
    """A row for every calendar day of each key's range; missing ones are null."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    grid = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias(ts))
    return grid.join(df, [*keys, ts], "left")
