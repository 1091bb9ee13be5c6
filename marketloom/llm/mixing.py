"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: a source's share of the budget goes by its weight; no target exceeds
max_epochs times the source's size, and what is cut off is shared again by
weight.  That fixed point is min(cap, level x weight) for one level, found by
cumulative sums over the sources in order of cap / weight.

Selection: floor(target / size) complete epochs of every document, then a
fraction of one more epoch in order of the exponential key -ln(u) / quality,
up to the rest of the target.  Key ranges are summed first; only the one range
per source in which the target falls is ordered row by row, so a source that
holds most rows is never gathered in one task.  Ranges are equal parts of the
key's logarithm, where a quality only shifts the keys: whatever the qualities,
a range holds about a 4000th of a source at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import identity, n_words, packed, quoted, stored

#: Key ranges in a doubling of the key.
RANGES = 1024


def quality_weight(text: Column) -> Column:
    """Square of the share of letters and spaces, at least 0.0025; 1 for no text."""
    text = F.coalesce(text, F.lit(""))
    rest = F.regexp_replace(text, r"[\p{L} ]+", "")  # runs go at once; counting matches would make a string of each letter
    share = (F.length(text) - F.length(rest)) / F.length(text)
    share = F.when(F.length(text) == 0, 1.0).otherwise(F.greatest(share, F.lit(0.05)))
    return share * share


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the columns alone (52 bits of MD5)."""
    parts = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(parts), 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, budget_share: float, cycle: list[float], max_epochs: float) -> DataFrame:
    """source, source_size -> and target.  One row per source; weights follow
    the sources' code point order, null last, and repeat.  All sizes 0: targets 0."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    rows = sizes.withColumn("w", F.element_at(weights, (F.row_number().over(by_name) - 1) % len(cycle) + 1))
    rows = rows.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "budget": F.lit(float(budget_share)) * F.sum("source_size").over(everything),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "w_rest": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # The level if exactly the sources before this one are cut off; it holds
    # for the first source that it leaves uncut.
    level = (F.col("budget") - F.col("cap_before")) / F.col("w_rest")
    rows = rows.withColumn("level", F.when(level * F.col("w") <= F.col("cap"), level))
    rows = rows.withColumn("level", F.max_by("level", F.when(F.col("level").isNotNull(), -F.col("cap") / F.col("w"))).over(everything))
    return rows.select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target")
    )


def mix(
    df: DataFrame,
    budget_share: float = 1.5,
    cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_epochs: int = 2,
    source: str = "source",
    size: Column | None = None,
    quality: Column | None = None,
    key: tuple[str, ...] = ("doc_id",),
    seed: int = 7,
) -> DataFrame:
    """df with size, source_size, target and copies (times the mix takes the row).

    size: words of the whole text by default; a null text has 0.  quality:
    weight of the row in the fractional epoch, by default quality_weight(text).
    key: columns that give a row its random number; rows equal in them are
    ordered by a hash of all values, and are interchangeable if that is equal
    too.  Input columns with the names of the output are replaced; others may
    have any names.  Null source is a source; a source of empty texts has target
    0.  An empty table gives an empty table.  The total taken from a source
    differs from its target by at most half of the row at which the target
    falls, and copies is at most max_epochs.
    """
    size = n_words(F.col("text")) if size is None else size
    quality = quality_weight(F.col("text")) if quality is None else quality
    of = F.col(quoted(source))
    u = uniform(F.lit(seed), *[F.col(quoted(c)) for c in key])
    rows = df.select(
        packed(df, ("size", "source_size", "target", "copies")), size.cast("long").alias("size"), (-F.log(u) / quality).alias("key"), of.alias("source"),
        of.isNull().alias("unnamed"), F.coalesce(of.cast("string"), F.lit("")).alias("name"), identity(df, 8).alias("tie"),
    )
    rows = rows.withColumn("range", F.floor(F.log2("key") * RANGES).cast("int"))
    names = ["unnamed", "name"]
    sums = stored(rows.groupBy(*names, "range").agg(F.sum("size").alias("sum"), F.first("source").alias("source")), "mix-ranges")
    targets = source_targets(
        sums.groupBy(*names).agg(F.sum("sum").alias("source_size"), F.first("source").alias("source")).select("source", "source_size"),
        budget_share, list(cycle), max_epochs,
    ).select(F.col("source").isNull().alias("unnamed"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"), "source_size", "target")
    upto = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    bounds = sums.drop("source").withColumn("end", F.sum("sum").over(upto)).join(targets, names)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    bounds = bounds.withColumn("epochs", epochs.cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    start = F.col("end") - F.col("sum")
    cut = (F.col("end") > F.col("rest")) & (start < F.col("rest"))
    bounds = bounds.select(
        *names, "range", "source_size", "target", "epochs", F.when(cut, F.col("rest") - start).alias("cut"),
        ((F.col("rest") > 0) & (F.col("end") <= F.col("rest"))).alias("whole"),
    )
    placed = rows.drop("source").join(bounds, [*names, "range"])
    out = lambda d, more: d.select("row.*", "size", "source_size", "target", (F.col("epochs") + more).cast("int").alias("copies"))
    ordered = Window.partitionBy(*names).orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("size").over(ordered) - F.col("size") / 2
    inside = placed.where(F.col("cut").isNotNull()).withColumn("in", (middle <= F.col("cut")).cast("int"))
    return out(placed.where(F.col("cut").isNull()), F.col("whole").cast("int")).unionByName(out(inside, F.col("in")))


def op8_mixing_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = stored(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("words"), quality_weight(F.col("text")).alias("quality")),
        "mix-input",
    )
    mixed = mix(narrow, size=F.col("words"), quality=F.col("quality"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")
