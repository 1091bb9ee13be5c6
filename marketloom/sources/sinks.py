"""Sinks: append, replace one key, swap a whole table, export small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, by: tuple[str, ...] = ("symbol",)) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace_keys(df: DataFrame, path: str, by: tuple[str, ...] = ("symbol",)) -> None:
    """Replace the partitions that df has rows for; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def swap(df: DataFrame, path: str) -> None:
    """Write beside the table, then rename; the old table stays as <path>_prev.

    The one before it goes only when the new table is in place.  If the last
    rename fails, the old table is put back; in the moment between the renames
    readers find it at <path>_prev.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    table, new, old, older = (make(path + x) for x in ("", "_new", "_prev", "_older"))
    fs = table.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + "_new")
    fs.delete(older, True)
    had, kept = fs.exists(table), fs.exists(old)
    if had and kept and not fs.rename(old, older):
        raise OSError(f"can't move {path}_prev away")
    if had and not fs.rename(table, old):
        raise OSError(f"can't move {path} away")
    if not fs.rename(new, table):
        if had:
            fs.rename(old, table)
        raise OSError(f"can't move {path}_new to {path}")
    fs.delete(older, True)


def export_csv(df: DataFrame, path: str) -> None:
    """A report (a few rows) as one CSV file with a header, in a folder."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def export_json(df: DataFrame, path: str) -> None:
    """A report as one file of JSON lines; NaN and infinities are null."""
    safe = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*safe).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
