"""name -> query, and name -> the SQL that gives the same rows.

The query modules register themselves with :func:`query`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, **more: int) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.withColumns({c: F.round(c, more.get(c, digits)) for c, t in df.dtypes if t == "double"})


def load() -> None:
    """Import the query modules; each can also be imported on its own."""
    from marketloom.plans import adaptive_queries, bar_queries, causal_queries, decision_queries, expert_queries, extreme_queries, file_queries, forecast_queries, relational_queries, research_queries, score_queries, sequence_queries, tail_queries  # noqa: F401
