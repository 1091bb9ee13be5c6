"""Rules that must pass four gates: chance, what is known anyway, every symbol, later years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators import scoring

CLASSES = 3


def matches(df: DataFrame, features: dict[str, Column], keep: list[str]) -> DataFrame:
    """keep and rule: each row with the one- and two-literal conjunctions it
    satisfies, built within the row; a null feature satisfies none."""
    literals = F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in sorted(features.items())]))
    rows = df.select(*keep, literals.alias("__lit"))
    after = lambda a, i: F.transform(F.slice("__lit", i + 2, F.size("__lit")), lambda b: F.concat(a, F.lit(" & "), b))
    pairs = F.flatten(F.transform("__lit", after))
    return rows.select(*keep, F.explode(F.concat("__lit", pairs)).alias("rule"))


def only_about(rule: Column, features: tuple[str, ...]) -> Column:
    """Whether all literals of a rule are about these features: such a rule restates the base model."""
    return F.forall(F.split(rule, " & "), lambda x: F.substring_index(x, "=", 1).isin(*features))


def step_down(hypotheses: DataFrame, null: DataFrame, keys: list[str], draws: int) -> DataFrame:
    """hypotheses (keys, z) with p: Westfall and Young's step-down over the
    largest |z| of the hypotheses that are not stronger, in each draw; monotone
    in the order of rejection.  null: keys, draw, z.  Windows hold the hypotheses of a draw."""
    ranked = hypotheses.withColumn("__a", F.abs("z"))
    order = [F.col("__a"), *map(F.col, keys)]
    worst = F.max(F.abs("__null")).over(Window.partitionBy("draw").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = null.select(*keys, "draw", F.col("z").alias("__null")).join(ranked.select(*keys, "__a"), keys)
    beyond = joined.withColumn("__worst", worst).groupBy(*keys).agg(F.count_if(F.col("__worst") >= F.col("__a")).alias("__b"))
    p = (1 + F.col("__b")) / (draws + 1)
    down = Window.orderBy(F.col("__a").desc(), *[F.col(k).desc() for k in keys]).rowsBetween(Window.unboundedPreceding, 0)  # a row for each hypothesis
    return ranked.join(beyond, keys).withColumn("p", F.max(p).over(down)).drop("__a", "__b")


def four_gates(
    df: DataFrame, features: dict[str, Column], y: str, control: str, base: tuple[str, ...], symbol: str = "symbol", ts: str = "day",
    draws: int = 100, run: int = 20, least: int = 100, level: float = 0.05, least_t: float = 2.0, later_z: float = 1.0,
) -> DataFrame:
    """rule, y, n, lift, z, p, is_base, t, everywhere, z_later, passed (0 to 4) of
    every conjunction and class.

    df has train (boolean): rows to discover in; others confirm.  Gates, each for
    those that passed the one before: (1) step-down p below level against
    permutations of runs of rows within symbols; (2) not about base features
    alone, and |t| of the rule beside the control, in a regression of the class;
    null where the control explains the rule; (3) the lift is on the same side
    of 1 without any one symbol; (4) later z on the same side, later_z at least.

    All but the permutations is one aggregation by rule, symbol and span: the
    regression is closed in sums, leaving out a symbol is a difference.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(control).isNotNull() & F.col("train").isNotNull())
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(symbol, "train").orderBy(ts)) - 1)
    c = F.col(control).cast("double")
    classes = F.explode(F.array(*[F.lit(k) for k in range(CLASSES)])).alias("y")
    hit = F.sum((F.col("__y") == F.col("y")).cast("double"))
    flat = rows.select(symbol, "train", F.col(y).alias("__y"), c.alias("__c"), classes)
    total = flat.groupBy(symbol, "train", "y").agg(F.count(F.lit(1)).cast("double").alias("all_n"), hit.alias("all_hits"), F.sum("__c").alias("all_c"), F.sum(F.col("__c") * F.col("__c")).alias("all_cc"), F.sum(F.when(F.col("__y") == F.col("y"), F.col("__c")).otherwise(0.0)).alias("all_cy"))
    long = matches(rows.withColumns({"__y": F.col(y), "__c": c}), features, [symbol, "train", "__place", "__y", "__c"])
    own = long.select(symbol, "train", "rule", "__y", "__c", classes).groupBy("rule", symbol, "train", "y").agg(F.count(F.lit(1)).cast("double").alias("n"), hit.alias("hits"), F.sum("__c").alias("mc"))
    own, total = own.checkpoint(), total.checkpoint()  # a row for each rule or class, symbol and span

    spans = lambda d, keys, names: d.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in names])
    whole = spans(total, ["train", "y"], ["all_n", "all_hits", "all_c", "all_cc", "all_cy"])
    rule = spans(own, ["rule", "train", "y"], ["n", "hits", "mc"]).join(whole, ["train", "y"])
    share = F.col("all_hits") / F.col("all_n")
    over = lambda a, b: F.try_divide(a, b)  # noqa: E731  (a class that no row or every row has has no z)
    z = over(F.col("hits") - F.col("n") * share, F.sqrt(F.col("n") * share * (1 - share)))
    rule = rule.withColumns({"base": share, "z": z})
    found = rule.where(F.col("train") & (F.col("n") >= least) & F.col("z").isNotNull())
    smm, smc, scc = F.col("n") - F.col("n") * F.col("n") / F.col("all_n"), F.col("mc") - F.col("n") * F.col("all_c") / F.col("all_n"), F.col("all_cc") - F.col("all_c") * F.col("all_c") / F.col("all_n")
    smy, scy, syy = F.col("hits") - F.col("n") * F.col("all_hits") / F.col("all_n"), F.col("all_cy") - F.col("all_c") * F.col("all_hits") / F.col("all_n"), F.col("all_hits") - F.col("all_hits") * F.col("all_hits") / F.col("all_n")
    beside = lambda a: F.coalesce(over(a, scc), F.lit(0.0))  # noqa: E731  (a control without spread explains nothing)
    rest = smm - beside(smc * smc)
    b = over(smy - beside(scy * smc), F.col("rest"))
    found = found.withColumn("rest", rest).withColumn("b", b).withColumn("t", F.when(F.col("rest") > 0.01 * smm, over(F.col("b"), F.sqrt(over(over(syy - beside(scy * scy) - F.col("b") * F.col("b") * F.col("rest"), F.col("all_n") - 3), F.col("rest"))))))
    found = found.select("rule", "y", "n", (F.col("hits") / F.col("n") / F.col("base")).alias("lift"), "z", "t", "base", "hits", "all_n", "all_hits")

    drawn = scoring.permuted_runs(rows.where("train").select(F.col(symbol).alias("symbol"), F.col("__place").alias("place"), F.col(y).alias("__y")), "__y", run, draws)
    held = long.where("train").select(F.col(symbol).alias("symbol"), F.col("__place").alias("place"), "rule").join(found.select("rule").distinct(), "rule")
    null = drawn.join(held, ["symbol", "place"]).select("rule", "draw", "__y", classes).groupBy("rule", "draw", "y").agg(hit.alias("k"))
    null = null.join(found.select("rule", "y", "n", "base"), ["rule", "y"]).select("rule", "y", "draw", ((F.col("k") - F.col("n") * F.col("base")) / F.sqrt(F.col("n") * F.col("base") * (1 - F.col("base")))).alias("z"))
    tested = step_down(found.select("rule", "y", "z"), null, ["rule", "y"], draws).select("rule", "y", "p")

    every = found.join(total.where("train").select(symbol, "y", F.col("all_n").alias("s_all"), F.col("all_hits").alias("s_all_hits")), "y")  # symbols are few beside rows
    every = every.join(own.where("train").select("rule", symbol, "y", F.col("n").alias("sn"), F.col("hits").alias("sh")), ["rule", symbol, "y"], "left").fillna(0.0, ["sn", "sh"])
    without = F.try_divide(F.try_divide(F.col("hits") - F.col("sh"), F.col("n") - F.col("sn")), over(F.col("all_hits") - F.col("s_all_hits"), F.col("all_n") - F.col("s_all")))
    side = every.groupBy("rule", "y").agg(F.min(F.coalesce(without, F.lit(0.0))).alias("low"), F.max(F.coalesce(without, F.lit(9e9))).alias("high"))
    later = rule.where(~F.col("train")).select("rule", "y", F.col("z").alias("z_later"))
    out = found.join(tested, ["rule", "y"]).join(side, ["rule", "y"]).join(later, ["rule", "y"], "left")
    out = out.withColumns({"is_base": only_about(F.col("rule"), base), "everywhere": F.when(F.col("z") > 0, F.col("low") > 1).otherwise(F.col("high") < 1)})
    one = F.col("p") < level
    two = one & ~F.col("is_base") & F.coalesce(F.abs("t") > least_t, F.lit(False))
    three = two & F.col("everywhere")
    four = three & F.coalesce((F.signum("z") * F.col("z_later")) >= later_z, F.lit(False))
    passed = sum((g.cast("int") for g in (two, three, four)), one.cast("int"))
    return out.select("rule", "y", F.col("n").cast("long").alias("n"), "lift", "z", "p", "is_base", "t", "everywhere", "z_later", passed.alias("passed"))
