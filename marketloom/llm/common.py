"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only by a local master that names no shared folder.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/marketloom"

#: A word: a run of characters that are neither space nor U+0009-U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = LOCAL_CHECKPOINTS
    return root.rstrip("/")


#: Spark's setting that removes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What stored() writes inside is removed at the end.  Results that read it
    must have been written by then."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.append(path)
    try:
        yield
    finally:
        _scratch.remove(path)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind; else they stay until the
    driver's memory is collected, which for a large job may be its end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and
    a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{_scratch[-1] if _scratch else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever it has in it."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame, without: Iterable[str] = ()) -> list[Column]:
    """The columns of df but those named; names have no case, as in Spark."""
    left_out = {c.lower() for c in without}
    return [df[quoted(c)] for c in df.columns if c.lower() not in left_out]


def packed(df: DataFrame, without: Iterable[str] = ()) -> Column:
    """The columns of df as one struct, so that no name can clash with those of
    an operator; select("row.*") gives them back."""
    return F.struct(*columns(df, without)).alias("row")


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores until df has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def text_at(df: DataFrame, name: str = "text") -> int:
    """Place of a column by its name, which has no case."""
    return next(i for i, c in enumerate(df.columns) if c.lower() == name.lower())


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], schema: T.StructType) -> DataFrame:
    """mapInArrow for tables with any column names; run gives the columns of schema."""
    names = [f"c{i}" for i in range(len(schema))]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in run(batches):
            yield pa.RecordBatch.from_arrays(made, names=names)

    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields, strict=True)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(named, plain).toDF(*schema.names)


def identity(df: DataFrame, seed: int) -> Column:
    """64 bits of the values of a row.  Nulls count; arrays and maps count as JSON."""
    parts: list[Column] = []

    def add(kind: T.DataType, col: Column) -> None:
        parts.append(col.isNull())
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                add(f.dataType, col.getField(f.name))
        else:
            parts.append(F.to_json(F.struct(col.alias("v"))) if isinstance(kind, (T.ArrayType, T.MapType)) else col)

    for field, col in zip(df.schema.fields, columns(df), strict=True):
        add(field.dataType, col)
    return F.xxhash64(F.lit(seed), *parts)


def held_out(doc_id: str | object = "doc_id"):
    """True for the fifth of documents that is never learned from (a null id
    is learned from)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def n_words(text):
    """Number of words of the whole text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
