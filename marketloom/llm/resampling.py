"""Importance resampling towards a target's distribution of hashed word runs.

Features are all runs of one to n words.  One scan of a document keeps a ring
with the running CRC-32 states of the last n starts: a word extends every state
by a space and itself, and opens a new one, so each run's CRC comes from the
run before it and no run is put together as text.  The scan emits buckets.

Bucket counts of source and target (a row for each bucket, whatever the data)
give each bucket's gain; a document's weight is the mean gain of its features.
Weights with Gumbel noise make the highest scores a draw without replacement.

The highest scores are found in two steps: counts by band of scores say which
bands can be drawn, and their rows alone are ordered, in ranges of the order
whose sizes give each range its first rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm import textnp as tn
from marketloom.llm.common import columns, map_batches, packed, stored, table, text_at

#: Bytes to letters a-z, digits and bytes from 0x80; all others to a space.
WORDS = np.where(tn.PUNCTUATION, np.uint8(32), tn.LOWER).astype(np.uint8).tobytes()
#: Scores in a band.
BAND = 64


def ring_buckets(words: list[bytes], n: int, buckets: int) -> np.ndarray:
    """Bucket of each run of 1 to n of the words, in order of the runs' ends."""
    if n == 1:
        made = list(map(crc32, words))
    else:
        made, ring = [], []
        for w in words:
            more = b" " + w
            ring = [crc32(more, state) for state in ring[-(n - 1) :]]
            ring.append(crc32(w))
            made += ring
    return (np.array(made, np.int64) % buckets).astype(np.int32)


def featurize(df: DataFrame, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """df with n_words (long) and features (array of buckets, repeats counted).

    Whole texts of any length are read; a null text, or one without words, has
    no features.  Input columns with these names are replaced, others may have
    any names.  An empty table gives an empty table.
    """
    df = df.select(*columns(df, ("n_words", "features")))
    at_text = text_at(df)
    schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("features", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            counts, made = [], []
            data, at = tn.buffers(batch.column(at_text))
            for i in range(batch.num_rows):
                words = data[at[i] : at[i + 1]].tobytes().translate(WORDS).split()
                counts.append(len(words))
                made.append(ring_buckets(words, n, buckets))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in made])])
            flat = pa.array(np.concatenate([np.empty(0, np.int32), *made]))
            yield [*batch.columns, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]

    return map_batches(df, run, schema)


def bucket_counts(featured: DataFrame) -> dict[int, int]:
    """Occurrences of each bucket: at most as many rows as there are buckets."""
    one = featured.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return {r["bucket"]: r["n"] for r in one.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed shares, rounded down."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([floor(1000 * log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(buckets)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a standard Gumbel number from the id alone, rounded down; a null id's is that of "null"."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _ranked(rows: DataFrame, n_rows: int, draws: int, range_rows: int) -> DataFrame:
    """rows (score, doc_id, row, ...) with rank, those beyond draws with null.
    Rows that tie in score and id are ordered by a number of their own, so a
    repeated row is in as many ranges as it needs."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("serial").asc()]
    ranges = max(8, -(-n_rows // range_rows))
    numbered = rows.withColumn("serial", F.monotonically_increasing_id()).repartitionByRange(ranges, *order)
    dealt = stored(numbered.withColumn("range", F.spark_partition_id()), "resample-ranges")
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    out = dealt.join(first, "range").withColumn("rank", place.cast("long"))
    return out.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank"))).drop("serial", "range", "before")


def resample(
    source: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, range_rows: int = 500_000
) -> DataFrame:
    """source with n_features, weight, score and rank (all long).

    source and target are tables of :func:`featurize`, read more than once, so
    store them where texts are long to scan; the columns n_words and features
    of source are dropped.  Of rows with at least least_words words, percent %
    (rounded down) are drawn; rank is 1, 2, ... by score descending, then
    doc_id (null last), and null for others.  Rows equal in both are ordered
    arbitrarily but once.  Without features the weight is 0.  A target without
    rows is a uniform one.  Columns may have any names; those of the result are
    replaced.  An empty source gives an empty table.
    """
    share = gains(bucket_counts(source), bucket_counts(target), buckets)
    names = ("n_features", "weight", "score", "rank")
    rows = source.select(packed(source, ("n_words", "features", *names)), F.col("doc_id"), F.col("n_words"), F.col("features"))
    shared = source.sparkSession.sparkContext.broadcast(share)
    at, own = rows.columns.index("features"), [f for f in rows.schema.fields if f.name != "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            lists = batch.column(at)
            size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            sums = np.concatenate([[0], np.cumsum(shared.value[np.asarray(lists.flatten(), np.int64)])])
            ends = np.cumsum(size)
            weight = (sums[ends] - sums[ends - size]) // np.maximum(size, 1)
            yield [*[c for i, c in enumerate(batch.columns) if i != at], pa.array(size), pa.array(weight)]

    weighed = map_batches(rows, run, T.StructType([*own, T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())]))
    weighed = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    weighed = stored(weighed.withColumn("band", F.when(F.col("n_words") >= least_words, F.floor(F.col("score") / BAND))), "resample-scores")
    # Scores are logarithms of counts, so there are some hundred bands at most.
    bands = sorted(((r["band"], r["n"]) for r in weighed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect() if r["band"] is not None), reverse=True)
    draws = sum(n for _, n in bands) * percent // 100
    lowest, drawn = None, 0
    for band, n in bands:
        if drawn >= draws:
            break
        lowest, drawn = band, drawn + n
    inside = F.coalesce(F.col("band") >= (lowest if lowest is not None else 2**40), F.lit(False))
    ranked = _ranked(weighed.where(inside), drawn, draws, range_rows)
    out = weighed.where(~inside).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)
    return out.select("row.*", *names)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document with its weight and, if drawn, its rank; the target is the benchmark's texts."""
    docs = stored(featurize(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "resample-features")
    items = featurize(table(spark, sf_dir, "benchmark").select("text")).drop("text")
    return resample(docs, items)
