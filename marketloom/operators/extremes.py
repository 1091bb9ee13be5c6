"""Tails: generalised Pareto fits, quantiles over all rows so far, shifts of distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators import gram, scoring

#: Bounds and points of the grid of the Pareto fit's unknown, and how often it is drawn closer.
SPAN, POINTS, ROUNDS = 8.0, 65, 3


def fit_pareto(excesses: DataFrame, keys: list[str], excess: str = "x", weight: str = "w", least: int = 30) -> DataFrame:
    """keys, n_excess, shape, scale: weighted likelihood of a generalised Pareto law.

    With t = shape / scale, the best shape is the weighted mean of
    ln(1 + t x), so one unknown is left.  t = (exp(v) - 1) / max x takes every
    allowed value as v runs over the line; each round sums ln(1 + t x) at the
    points of a grid of v for all groups at once and draws the bounds to the best
    point's neighbours, and a parabola through the last three gives v.  Shapes
    of -1 or less, where the likelihood has no bound, are left out.  Groups with
    fewer than `least` excesses have no row.
    """
    rows = excesses.select(*keys, F.col(excess).cast("double").alias("x"), F.col(weight).cast("double").alias("w")).where("x > 0 and w > 0")
    rows = rows.checkpoint()  # every round reads the excesses
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_excess"), F.max("x").alias("top"), F.sum("w").alias("mass"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean")).where(F.col("n_excess") >= least)
    bounds = base.withColumns({"low": F.lit(-SPAN), "high": F.lit(SPAN)})
    t = (F.exp("v") - 1) / F.col("top")
    tried = [*keys, "n_excess", "top", "mass", "mean", "low", "high", "g", "v"]

    def scored(points: DataFrame) -> DataFrame:
        sums = rows.join(points, keys).groupBy(*tried).agg((F.sum(F.col("w") * F.log1p(t * F.col("x"))) / F.first("mass")).alias("shape"))
        scale = F.when(F.col("v") == 0, F.col("mean")).otherwise(F.col("shape") / t)
        return sums.withColumn("scale", scale).withColumn("fit", F.when(F.col("shape") > -1, -F.log("scale") - F.col("shape") - 1))

    for _ in range(ROUNDS):
        step = (F.col("high") - F.col("low")) / (POINTS - 1)
        grid = bounds.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1)))).withColumn("v", F.col("low") + F.col("g") * step)
        ordered = Window.partitionBy(*keys).orderBy("g")
        near = scored(grid).withColumns({"before": F.lag("fit").over(ordered), "after": F.lead("fit").over(ordered), "step": step})
        best = near.groupBy(*keys).agg(F.max_by(F.struct("n_excess", "top", "mass", "mean", "v", "fit", "before", "after", "step"), "fit").alias("b"))
        bounds = best.select(*keys, "b.*").withColumns({"low": F.col("v") - F.col("step"), "high": F.col("v") + F.col("step")}).checkpoint()
    bend = F.col("before") - 2 * F.col("fit") + F.col("after")
    move = F.when(bend < 0, (F.col("before") - F.col("after")) / bend * F.col("step") / 2).otherwise(0.0)
    last = bounds.withColumns({"v": F.col("v") + F.coalesce(move, F.lit(0.0)), "g": F.lit(0)})
    return scored(last).select(*keys, "n_excess", "shape", "scale")


def pareto_quantile(threshold: Column, share: Column, shape: Column, scale: Column, p: float) -> Column:
    """The size that a share p of all rows exceed, if the share `share` exceeds the threshold."""
    far = F.log(share / p)
    return threshold + F.when(F.abs(shape) < 1e-6, scale * far).otherwise(scale / shape * (F.exp(shape * far) - 1))


def pareto_shortfall(threshold: Column, shape: Column, scale: Column, quantile: Column) -> Column:
    """Mean size beyond the quantile; null where it has none (shape of 1 or more)."""
    return F.when(shape < 1, F.greatest((quantile + scale - shape * threshold) / (1 - shape), quantile))


def peaks_over_threshold(df: DataFrame, key: str, loss: str, weight: str, ts: str, level: float = 0.9, p: float = 0.01, least: int = 30) -> DataFrame:
    """key, n, threshold, n_excess, shape, scale, quantile, shortfall of weighted losses."""
    limit = scoring.weighted_quantile(df, loss, weight, level, key, ts).select(key, F.col(f"q{int(level * 100)}").alias("threshold"))
    rows = df.join(limit, key)
    beyond = F.col(loss) > F.col("threshold")
    share = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first("threshold").alias("threshold"), (F.sum(F.when(beyond, F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("share"))
    fit = fit_pareto(rows.where(beyond).select(key, (F.col(loss) - F.col("threshold")).alias("x"), F.col(weight).alias("w")), [key], least=least)
    out = share.join(fit, key).withColumn("quantile", pareto_quantile(F.col("threshold"), F.col("share"), F.col("shape"), F.col("scale"), p))
    out = out.withColumn("shortfall", pareto_shortfall(F.col("threshold"), F.col("shape"), F.col("scale"), F.col("quantile")))
    return out.select(key, "n", "threshold", "n_excess", "shape", "scale", "quantile", "shortfall")


def expanding_tails(df: DataFrame, value: str, level: float, key: str = "symbol", ts: str = "day", burn: int = 250, every: int = 21) -> DataFrame:
    """df with q and tail: quantile (linear) of all values before the row's block
    of `every` rows, and mean of those at or below it; null in the burn-in.

    A key's values are cut into about sqrt(n) ranges of their order; a value that
    alone fills a range has one for itself.  Counts and sums of each block by
    range, summed over blocks, say in which range a block's order statistic lies
    and at which place there; only that range's rows are looked at.  So n values
    take about n sqrt(n) / every steps, nothing keeps all past rows at hand, and
    counts of new blocks can be added to old ones.
    """
    by = Window.partitionBy(key)
    rows = df.where(F.col(value).isNotNull()).withColumn("place", F.row_number().over(by.orderBy(ts)) - 1)
    rows = rows.withColumn("block", F.when(F.col("place") >= burn, F.floor((F.col("place") - burn) / every) + 1).otherwise(F.lit(0)).cast("long"))
    width = F.ceil(F.sqrt(F.count(F.lit(1)).over(by)))
    filling = F.count(F.lit(1)).over(Window.partitionBy(key, value)) >= width
    rows = rows.withColumns({"single": filling, "range": F.floor((F.rank().over(by.orderBy(value)) - 1) / width) * 2 + filling.cast("long")})
    seen = rows.select(key, "block", "range", "single", F.col(value).alias("v"))
    counts = seen.groupBy(key, "block", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    ranges = seen.groupBy(key, "range").agg(F.first("single").alias("single"), F.min("v").alias("least"))
    past = Window.partitionBy(key, "range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key, "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = counts.select(key, "block").distinct().join(ranges, key).join(counts, [key, "block", "range"], "left").fillna(0, ["n", "s"])
    held = held.withColumns({"n": F.coalesce(F.sum("n").over(past), F.lit(0)), "s": F.coalesce(F.sum("s").over(past), F.lit(0.0))}).where("block > 0")
    held = held.withColumns({"below": F.coalesce(F.sum("n").over(upto), F.lit(0)), "below_sum": F.coalesce(F.sum("s").over(upto), F.lit(0.0)), "all": F.sum("n").over(Window.partitionBy(key, "block"))})
    h = (F.col("all") - 1) * F.lit(level)
    held = held.withColumns({"low": F.floor(h), "part": h - F.floor(h)})
    # The two order statistics may lie in neighbouring ranges.
    hit = held.where((F.col("n") > 0) & (F.col("low") + 1 >= F.col("below")) & (F.col("low") < F.col("below") + F.col("n")))
    at = [key, "block", "low", "part", "below", "below_sum"]
    inside = hit.where("not single").select(*at, "range").join(seen.select(key, "range", F.col("block").alias("made"), "v"), [key, "range"]).where("made < block")
    k = F.row_number().over(Window.partitionBy(key, "block", "range").orderBy("v")) - 1 + F.col("below")
    inside = inside.select(*at, "v", k.alias("k0"), k.alias("k1"))
    near = inside.unionByName(hit.where("single").select(*at, F.col("least").alias("v"), F.col("below").alias("k0"), (F.col("below") + F.col("n") - 1).alias("k1")))
    nth = lambda k: F.max(F.when((F.col("k0") <= k) & (F.col("k1") >= k), F.col("v")))
    two = near.groupBy(key, "block").agg(nth(F.col("low")).alias("a"), nth(F.col("low") + 1).alias("b"), F.first("part").alias("part"), F.min(F.struct("below", "below_sum")).alias("first"))
    two = two.withColumn("q", F.col("a") + F.coalesce(F.col("part") * (F.col("b") - F.col("a")), F.lit(0.0)))
    times = F.col("k1") - F.col("k0") + 1
    low = near.join(two.select(key, "block", "q", "first"), [key, "block"]).where("v <= q")
    low = low.groupBy(key, "block").agg(F.sum(times).alias("c"), F.sum(times * F.col("v")).alias("t"), F.first("first").alias("first"), F.first("q").alias("q"))
    tails = low.select(key, "block", "q", ((F.col("first.below_sum") + F.col("t")) / (F.col("first.below") + F.col("c"))).alias("tail"))
    return rows.join(tails, [key, "block"], "left").drop("place", "block", "range", "single")


def shift_scores(df: DataFrame, key: str, after: str, features: list[str], fold: str, clip: float = 0.02) -> DataFrame:
    """df with score and ratio: can rows after a date be told from those before?

    The score of a row is its regression of `after` (0 or 1) on the features
    whose coefficients come from the other folds.  ratio estimates how much
    likelier the row's features are after than before.
    """
    rows = df.where(gram.known([*features, after])).withColumn("__y", F.col(after).cast("double"))
    names = [*features, "__y"]
    sums = gram.without_own(gram.moments(rows, [key, fold], names), [key], len(names) + 1)
    y = f"m0_{len(names)}"
    fit = gram.regress(sums, names, features, "__y", "beta", ridge=1e-8).select(key, fold, "beta", (F.col(y) / (F.col("m0_0") - F.col(y))).alias("odds"))
    fit = fit.where("beta is not null").checkpoint()  # a row for each key and fold
    scored = rows.join(fit, [key, fold]).withColumn("score", gram.fitted("beta", features))
    p = F.least(F.greatest("score", F.lit(clip)), F.lit(1 - clip))
    return scored.withColumn("ratio", p / (1 - p) / F.col("odds")).drop("__y", "beta", "odds")


def shift_test(scored: DataFrame, key: str, after: str) -> DataFrame:
    """key, n_before, n_after, auc, z: area under the curve of the scores and its distance from 1/2 in standard errors (Mann-Whitney)."""
    a = scoring.auc(scored.withColumn("__y", F.col(after).cast("int")), "score", "__y", (key,))
    n = scored.groupBy(key).agg(F.count_if(F.col(after) == 0).alias("n_before"), F.count_if(F.col(after) == 1).alias("n_after"))
    spread = F.sqrt((F.col("n_before") + F.col("n_after") + 1) / (12.0 * F.col("n_before") * F.col("n_after")))
    return n.join(a.select(key, "auc"), key).select(key, "n_before", "n_after", "auc", ((F.col("auc") - 0.5) / spread).alias("z"))
