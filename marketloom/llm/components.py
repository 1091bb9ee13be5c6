"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): the least vertex of its component.

    Each round sends every vertex to the first among itself and its neighbours,
    and maps the edges along.  First is the least vertex in every other round,
    which settles stars about their least vertex at once, and the one with the
    least random number in the rest, drawn anew each time: whatever the order of
    the ids, such a round leaves about half of the vertices of a chain, and fewer
    of denser graphs.  The rounds are written tables; nothing is collected but
    their counts.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    both = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct()
    root = both.select("v", F.col("v").alias("root"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        drawn = lambda c: F.struct((F.xxhash64(F.lit(turn), c) if turn % 2 == 0 else F.lit(0).cast("long")).alias("n"), F.col(c).alias("v"))
        out = edges.union(edges.select("b", "a"))
        to = stored(out.groupBy("a").agg(F.least(drawn("a"), F.min(drawn("b")))["v"].alias("to")), "hooks")
        root = root.join(to, F.col("root") == F.col("a"), "left").select("v", F.coalesce("to", "root").alias("root"))
        mapped = edges.join(to.select("a", F.col("to").alias("x")), "a").select("x", "b")
        mapped = mapped.join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(
            mapped.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
        root = stored(root, "roots")
    least = root.groupBy("root").agg(F.min("v").alias("least"))
    return root.join(least, "root").select("v", F.col("least").alias("root"))
