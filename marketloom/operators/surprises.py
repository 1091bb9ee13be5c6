"""What markets did on the days of announcements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def market_surprises(events: DataFrame, closes: DataFrame, lead: str, others: Sequence[str], scale: float = 10_000.0) -> DataFrame:
    """day, surprise, abs_surprise and abs_<name> for each other symbol.

    A surprise is the move of the lead symbol's close over its last close before,
    in hundredths of a percent unless scale says otherwise; the other symbols
    give the size of theirs, or null if they have none on the day.  Days of
    events count once; events on days without a move of the lead symbol are left
    out, as are closes that are null or follow one of 0.
    """
    w = Window.partitionBy("symbol").orderBy("day")
    known = closes.where(F.col("symbol").isin(lead, *others) & F.col("close").isNotNull()).select("symbol", "day", "close")
    before = F.lag("close").over(w)
    moves = known.withColumn("move", F.when(before != 0, scale * (F.col("close") / before - 1))).where("move is not null")
    own = lambda s: F.max(F.when(F.col("symbol") == s, F.col("move")))
    size = lambda s: F.max(F.when(F.col("symbol") == s, F.abs("move")))
    found = moves.join(events.select("day").distinct(), "day", "left_semi").groupBy("day")
    return found.agg(own(lead).alias("surprise"), size(lead).alias("abs_surprise"), *[size(s).alias(f"abs_{s.lower()}") for s in others]).where("surprise is not null")
