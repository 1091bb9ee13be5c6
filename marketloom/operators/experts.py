"""Class forecasts from what was known: rates of past blocks, and what is made of several forecasts."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = 3


def place_in_blocks(df: DataFrame, horizon: int, burn: int, every: int, key: str = "symbol", ts: str = "day") -> DataFrame:
    """df with block (0 in the burn-in, then 1, 2, ... of `every` rows) and known,
    the block in which a row's outcome, `horizon` rows ahead, is seen."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(ts)) - 1
    block = lambda p: F.when(p >= burn, F.floor((p - burn) / every) + 1).otherwise(F.lit(0)).cast("long")
    return df.withColumns({"block": block(at), "known": block(at + horizon)})


def past_rates(df: DataFrame, y: str, by: list[str], name: str, prior: float = 1.0, key: str = "symbol") -> DataFrame:
    """df (with block and known) and name0, name1, name2: rates of the classes
    among rows of the key and of equal `by` whose outcome was seen before the
    block, with `prior` rows of each class more; null in the burn-in.

    Outcomes and questions go through one ordered stream of sums, a row for each
    block and value, so no block looks at its past again.
    """
    keys = [key, *by]
    counts = [f"__k{k}" for k in range(CLASSES)]
    seen = df.where(F.col(y).isNotNull()).groupBy(*keys, F.col("known").alias("block")).agg(*[F.count_if(F.col(y) == k).alias(c) for k, c in enumerate(counts)]).withColumn("__asked", F.lit(1))
    asked = df.where("block > 0").select(*keys, "block").distinct().select("*", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit(0).alias("__asked"))
    upto = Window.partitionBy(*keys).orderBy("block", "__asked").rowsBetween(Window.unboundedPreceding, 0)
    sums = asked.unionByName(seen).withColumns({c: F.sum(c).over(upto) for c in counts}).where("__asked = 0")
    total = reduce(lambda a, b: a + b, map(F.col, counts)) + CLASSES * prior
    rates = sums.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("block").alias("__block"), *[((F.col(c) + prior) / total).alias(f"{name}{k}") for k, c in enumerate(counts)])
    same = F.col("block") == F.col("__block")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(rates, same, "left").drop("__block", *[f"__{c}" for c in keys])


def tree_rules(forest) -> list[list[tuple[int, float, bool]]]:
    """The paths to every node but the roots of an MLlib forest, each once: (feature, threshold, at most it)."""
    out: dict[tuple, None] = {}

    def walk(node, path: tuple) -> None:
        if path:
            out[tuple(sorted(path))] = None
        if node.subtreeDepth() > 0:
            feature, threshold = node.split().featureIndex(), float(node.split().threshold())
            walk(node.leftChild(), (*path, (feature, threshold, True)))
            walk(node.rightChild(), (*path, (feature, threshold, False)))

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), ())
    return [list(p) for p in out]


def rule_columns(rules: list[list[tuple[int, float, bool]]], features: list[str]) -> Column:
    """An array of 0 and 1: which rules a row satisfies; a null satisfies none."""

    def holds(rule) -> Column:
        conditions = [(F.col(features[i]) <= t) if low else (F.col(features[i]) > t) for i, t, low in rule]
        return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False)).cast("double")

    return F.array(*[holds(r) for r in rules])


def fit_rule_ensemble(train: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 2, penalty: float = 0.003, seed: int = 1):
    """(model, rules): a multinomial logistic model with an L1 penalty over the
    rules of a forest and the features themselves; model.transform needs the
    vector of `rule_vector`."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = train.dropna(subset=[*features, label])
    vector = rows.withColumn("__x", array_to_vector(F.array(*[F.col(c).cast("double") for c in features])))
    forest = RandomForestClassifier(featuresCol="__x", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=20, seed=seed).fit(vector)
    rules = tree_rules(forest)
    model = LogisticRegression(featuresCol="__rules", labelCol=label, family="multinomial", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(rule_vector(rows, rules, features))
    return model, rules


def rule_vector(df: DataFrame, rules: list[list[tuple[int, float, bool]]], features: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    plain = F.array(*[F.col(c).cast("double") for c in features])
    return df.dropna(subset=features).withColumn("__rules", array_to_vector(F.concat(rule_columns(rules, features), plain)))


def fit_stack(train: DataFrame, probabilities: list[str], label: str, ridge: float = 0.001):
    """A multinomial logistic model over the logarithms of several forecasts' class probabilities."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol="__logs", labelCol=label, family="multinomial", regParam=ridge, maxIter=60).fit(stack_vector(train.dropna(subset=[label]), probabilities))


def stack_vector(df: DataFrame, probabilities: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.dropna(subset=probabilities).withColumn("__logs", array_to_vector(F.array(*[F.log(F.greatest(F.col(p), F.lit(1e-6))) for p in probabilities])))


def rank_auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the curve with ties at half."""
    values, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    pos = y > 0.5
    p, q = pos.sum(), (~pos).sum()
    return float((rank[pos].sum() - p * (p + 1) / 2) / (p * q)) if p and q else np.nan
