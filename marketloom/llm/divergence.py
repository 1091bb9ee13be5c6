"""How the sources of a language differ: pairwise distances and the terms a source has too often.

Terms are runs of letters (A-Z without case) and characters beyond ASCII.  Each
language keeps the terms that enough of its documents have; a group (language,
source) and the language itself give every kept term a smoothed share in
billionths, in exact integers.

Counting: tasks count terms per group over whole texts and hand on sums; their
sums per (language, term) are at most as many as there are sources.

Pairs: the distance of two sources is the sum of |p - q| over all kept terms.  A
term that a source lacks has the source's least share z, so

  distance = V |za - zb| + own(a, b) + own(b, a) + both(a, b)

own(a, b) sums |pa - zb| - |za - zb| over the terms of a.  A share depends on the
count alone, so it is taken over a's counts and the number of terms with each.
both corrects the terms that both have, from the postings of each term.

Top terms: a group's terms fall into buckets by their count, eight to a
doubling; the share of a bucket's greatest count less the least share that the
language has among its terms bounds the bucket's differences.  Buckets are
evaluated best bound first: first those that hold a few times `top` terms, then,
of the rest, those whose bound reaches the value at place `top` so far.  What is
never evaluated has bounds strictly below that value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm import textnp as tn
from marketloom.llm.common import map_batches, quoted, stored, table

#: Bytes to letters a-z and bytes from 0x80; all others to a space.
TERMS = np.where(tn.PUNCTUATION | np.isin(np.arange(256), np.arange(48, 58)), np.uint8(32), tn.LOWER).astype(np.uint8).tobytes()
#: Terms that a task counts before it hands on their sums.
HELD = 300_000
#: Buckets of counts in a doubling, and terms of the first buckets as a multiple of top.
STEPS, AHEAD = 8, 4
#: Numerator of shares, in three digits of the base.
BASE = 1000

COUNTS = T.StructType().add("lang", "string").add("source", "string").add("term", "string").add("count", "long").add("docs", "long")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """(lang, source, term, count, documents) of texts, summed as far as a task holds them."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flushed() -> list[pa.Array]:
        n = [len(counts) for counts, _ in held.values()]
        lang, source = (pa.array([g[i] for g in held], pa.string()).take(pa.array(np.repeat(np.arange(len(n)), n))) for i in (0, 1))
        terms = pa.array([w for counts, _ in held.values() for w in counts], pa.binary()).cast(pa.string())
        count = pa.array([c for counts, _ in held.values() for c in counts.values()], pa.int64())
        return [lang, source, terms, count, pa.array([docs[w] for counts, docs in held.values() for w in counts], pa.int64())]

    for batch in batches:
        data, at = tn.buffers(batch.column(2))
        groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        for i, group in enumerate(groups):
            words = data[at[i] : at[i + 1]].tobytes().translate(TERMS).split()
            counts, docs = held.get(group) or held.setdefault(group, (Counter(), Counter()))
            size -= len(counts)
            counts.update(words)
            docs.update(set(words))
            size += len(counts)
            if size > HELD:
                yield flushed()
                held, size = {}, 0
    if size:
        yield flushed()


def share(count: str, total: str, terms: str, smoothing: int) -> Column:
    """1 + floor(10**9 * (count + smoothing) / (total + smoothing * terms)) of SQL expressions, null if nothing is counted.

    Long division, three digits of base 1000: exact for totals to 9 * 10**15.
    """
    d, rest, made = f"({total} + {smoothing} * {terms})", f"({count} + {smoothing})", ""
    for _ in range(4):
        made = f"({made} * {BASE} + {rest} div {d})" if made else f"({rest} div {d})"
        rest = f"({rest} % {d} * {BASE})"
    return F.expr(f"if({d} = 0, null, 1 + {made})")


def count_terms(df: DataFrame) -> DataFrame:
    """lang, source, term, count and docs (documents with the term) of a table with lang, source and text."""
    made = map_batches(df, _count_terms, COUNTS)
    return made.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _pairs(postings: DataFrame, groups: DataFrame, smoothing: int) -> DataFrame:
    """lang, a, b, value of the sources a < b of a language."""
    salts = 16  # a language may hold most rows
    own = groups.select("lang", F.col("source").alias("a"), F.col("n").alias("a_n"), F.col("kept").alias("a_kept"), F.col("z").alias("za"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    spread = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    apart = F.abs(F.col("za") - F.col("zb"))
    base = own.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int")).join(spread, ["lang", "salt"]).where("a < b")
    base = base.select("lang", "a", "b", F.coalesce(F.col("a_kept") * apart, F.lit(0)).alias("value"))
    by_count = postings.groupBy("lang", F.col("source").alias("a"), "count").agg(F.count(F.lit(1)).alias("times")).join(own, ["lang", "a"])
    by_count = by_count.withColumns({"p": share("count", "a_n", "a_kept", smoothing), "salt": F.pmod(F.xxhash64("a", "count"), F.lit(salts)).cast("int")})
    alone = by_count.join(spread, ["lang", "salt"]).where("a <> b").select("lang", *ordered, (F.col("times") * (F.abs(F.col("p") - F.col("zb")) - apart)).alias("value"))
    shares = postings.join(groups, ["lang", "source"]).select("lang", "term", "source", share("count", "n", "kept", smoothing).alias("p"), "z")
    left = shares.withColumnsRenamed({"source": "a", "p": "pa", "z": "za"})
    right = shares.withColumnsRenamed({"source": "b", "p": "pb", "z": "zb"})
    met = F.abs(F.col("pa") - F.col("pb")) + apart - F.abs(F.col("pa") - F.col("zb")) - F.abs(F.col("za") - F.col("pb"))
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", met.alias("value"))
    return base.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _top_terms(postings: DataFrame, groups: DataFrame, smoothing: int, top: int) -> DataFrame:
    """lang, source, item, value, rank of each group's top terms."""
    group = ["lang", "source"]
    placed = postings.withColumn("bucket", F.floor(F.log2(F.col("count").cast("double")) * STEPS).cast("int"))
    buckets = placed.groupBy(*group, "bucket").agg(F.max("count").alias("most"), F.min("lang_count").alias("least"), F.count(F.lit(1)).alias("size")).join(groups, group)
    buckets = buckets.withColumn("bound", share("most", "n", "kept", smoothing) - share("least", "lang_n", "kept", smoothing))
    before = Window.partitionBy(*group).orderBy(F.col("bound").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = stored(
        buckets.where("bound > 0").select(*group, "bucket", "bound", "n", "lang_n", "kept", (F.coalesce(F.sum("size").over(before), F.lit(0)) < AHEAD * top).alias("first")),
        "divergence-buckets",
    )

    def evaluated(which: DataFrame) -> DataFrame:
        found = placed.join(which.select(*group, "bucket", "n", "lang_n", "kept"), [*group, "bucket"])
        value = share("count", "n", "kept", smoothing) - share("lang_count", "lang_n", "kept", smoothing)
        return found.select(*group, F.col("term").alias("item"), value.alias("value")).where("value > 0")

    first = stored(evaluated(buckets.where("first")), "divergence-first")
    reached = _ranked(first.select(*group, "value", F.lit("").alias("item")), group, top).where(F.col("rank") == top).select(*group, F.col("value").alias("reached"))
    rest = buckets.where("not first").join(reached, group, "left").where(F.col("bound") >= F.coalesce("reached", F.lit(1)))
    return _ranked(first.unionByName(evaluated(rest)), group, top)


def _ranked(df: DataFrame, group: list[str], top: int | None = None) -> DataFrame:
    """df with rank by value descending and item; with top, tasks hand on no
    more rows of a group than that."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("value").desc(), "item"))
    ranked = df.withColumn("rank", rank)
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def audit(df: DataFrame, least_docs: int = 30, smoothing: int = 5, top: int = 50, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank for each (lang, source) of df.

    part `pair`: item is each other source of the language and value their
    distance, 0 without kept terms; all of them.  part `term`: item is a kept
    term that the group has and value its share less the language's, if
    positive; the first `top`.  Ranks go by value descending, then item.

    Nulls in the three columns are read as ''.  Whole texts of any length are
    read, repeated rows count each.  Groups without terms have all counts 0.  df
    may have any other columns.  An empty table gives an empty table.
    """
    plain = df.select(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    term = Window.partitionBy("lang", "term")
    counts = count_terms(plain).withColumns({
        "lang_docs": F.sum("docs").over(term), "lang_count": F.sum("count").over(term),
        "once": (F.row_number().over(term.orderBy("source")) == 1).cast("long"),
    })
    postings = stored(counts.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "count", "lang_count", "once"), "divergence-postings")
    sums = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum("once").alias("kept"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n", "kept"])
    whole = Window.partitionBy("lang")  # a row for each source
    groups = groups.withColumns({"lang_n": F.sum("n").over(whole), "kept": F.sum("kept").over(whole)})
    groups = stored(groups.withColumn("z", share("0", "n", "kept", smoothing)), "divergence-groups")

    pairs = _pairs(postings, groups, smoothing)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    pairs = _ranked(pairs.select("lang", ways, "value").select("lang", "way.source", "way.item", "value"), ["lang", "source"])
    terms = _top_terms(postings, groups, smoothing, top)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*names).unionByName(terms.withColumn("part", F.lit("term")).select(*names))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))
