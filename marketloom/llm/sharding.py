"""Uniform sharding by a hypergeometric communication matrix.

Rows are dealt into blocks by a hash of their values and of their number among
equal rows, so equal rows go different ways.  The driver draws how many rows each
block sends to each shard: block by block, a multivariate hypergeometric draw
from the capacities that are left.  Row and column sums are exact, so shard
sizes are exact before any row moves.  Each block permutes its rows locally,
cuts the permutation at its row of the matrix, rows are exchanged, and each
shard permutes again.

Only DataFrame operations run on the executors.  The matrix has
blocks x shards entries; blocks grow as rows / rows_per_block.
"""

from __future__ import annotations

from math import exp, lgamma

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import columns, identity, packed, stored

#: Beyond this many entries the matrix is joined by shuffle, not broadcast.
BROADCAST_ENTRIES = 1_000_000


def shard_capacities(n_rows: int, shards: int) -> np.ndarray:
    """Exact sizes, at most one row apart."""
    return np.array([n_rows // shards + (s < n_rows % shards) for s in range(shards)], dtype=np.int64)


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> np.ndarray:
    """matrix[b, s]: rows that block b sends to shard s, as a uniform shuffle would."""
    rng = np.random.default_rng(seed)
    left = shard_capacities(sum(block_rows), shards)
    matrix = np.zeros((len(block_rows), shards), dtype=np.int64)
    for b, n in enumerate(block_rows):
        matrix[b] = _draw(rng, left, int(n))
        left = left - matrix[b]
    return matrix


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    if left.sum() < 10**9:  # numpy's limit; beyond it, shard by shard from the same law
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out, rest = np.zeros_like(left), int(left.sum())
    for s, have in enumerate(left):
        rest -= int(have)
        if rest == 0 or n == 0:
            out[s] = n
            break
        out[s] = _hypergeometric(rng, int(have), rest, n)
        n -= int(out[s])
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    # Inversion outward from the mode, by the ratio of neighbouring terms.
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    up = down = exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    left, above, below = rng.random() - up, mode, mode
    while left > 0 and (above < high or below > low) and max(up, down) > 0:
        if above < high:
            up *= (good - above) * (n - above) / ((above + 1) * (bad - n + above + 1))
            above += 1
            left -= up
            if left <= 0:
                return above
        else:
            up = 0.0
        if below > low:
            down *= below * (bad - n + below) / ((good - below + 1) * (n - below + 1))
            below -= 1
            left -= down
            if left <= 0:
                return below
        else:
            down = 0.0
    return mode


def _numbered(values: DataFrame) -> DataFrame:
    """values (v, w) with number: 0, 1, ... among equal rows.  Partitions count
    their own, and the counts give each its first number, so a value that many
    rows have is never in one task."""
    parts = values.groupBy("v", "w", F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    counts = stored(parts, "shard-counts")
    before = Window.partitionBy("v", "w").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return first.select("v", "w", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("number"))


def _assigned(values: DataFrame, shards: int, seed: int, rows_per_block: int, min_blocks: int) -> DataFrame:
    """values (v, w) with shard and slot."""
    numbered = stored(_numbered(values), "shard-numbered")
    n_rows = numbered.count()
    blocks = max(min_blocks, -(-n_rows // rows_per_block))
    drawn = lambda k: F.xxhash64(F.lit(seed * 31 + k), "v", "w", "number")
    keyed = numbered.select("v", "w", F.pmod(drawn(1), F.lit(blocks)).cast("int").alias("block"), drawn(2).alias("in"), drawn(3).alias("out"))

    counted = {r["block"]: r["n"] for r in keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([counted.get(b, 0) for b in range(blocks)], shards, seed)
    cuts = values.sparkSession.createDataFrame(
        [(b, row.tolist()) for b, row in enumerate(matrix.cumsum(axis=1))], "block int, cuts array<bigint>"
    )
    if matrix.size <= BROADCAST_ENTRIES:
        cuts = F.broadcast(cuts)
    place = F.row_number().over(Window.partitionBy("block").orderBy("in", "out"))
    dealt = keyed.withColumn("place", place).join(cuts, "block").withColumn("shard", F.expr("cast(size(filter(cuts, c -> c < place)) as int)"))
    # The second permutation sorts each shard by `out`.  It is cut into ranges
    # of `out`, whose sizes give the first slot of each range, so no task
    # holds a shard.
    ranges = max(8, -(-n_rows // (shards * rows_per_block)))
    out = F.col("out").bitwiseAND(F.lit(2**63 - 1))
    dealt = dealt.select("v", "w", "shard", out.alias("out")).withColumn("range", F.expr(f"cast(out div {-(-(2**63) // ranges)} as int)"))
    dealt = stored(dealt, "shard-dealt")
    sizes = dealt.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if shards * ranges <= BROADCAST_ENTRIES:
        starts = F.broadcast(starts)
    rank = F.row_number().over(Window.partitionBy("shard", "range").orderBy("out", "v", "w"))
    slots = dealt.withColumn("rank", rank).join(starts, ["shard", "range"])
    return stored(slots.select("v", "w", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot")), "shard-slots")


def shard(df: DataFrame, shards: int = 8, seed: int = 20_24, rows_per_block: int = 100_000, min_blocks: int = 48) -> DataFrame:
    """df with int column shard and long column slot (from 0, gapless in each shard).

    128 bits of a row's values, and its number among equal rows, seed the
    permutations.  These keys alone are drawn, ranked and stored; then every
    distinct row moves once, to meet the places drawn for it.  Nulls count as
    values.  Input columns named shard or slot are replaced, others may have any
    names.  Texts may have any length.  An empty table gives an empty table.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = df.select(*columns(df, ("shard", "slot")))
    rows = kept.select(identity(kept, seed * 31 + 4).alias("v"), identity(kept, seed * 31 + 5).alias("w"), packed(kept))
    places = _assigned(rows.select("v", "w"), shards, seed, rows_per_block, min_blocks)
    once = rows.dropDuplicates(["v", "w"])
    return once.join(places, ["v", "w"]).select("row.*", "shard", "slot")


def op4_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    narrow = stored(narrow, "shard-input")
    return shard(narrow).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
