"""Class forecasts that compete and combine: experts from past blocks, their
mixture, stack and rules, and bootstraps of their skill."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import recursive
from marketloom.operators import experts, forecast, gates, scoring
from marketloom.operators import indicators as ind
from marketloom.plans import series_sql as ssql
from marketloom.plans.catalog import query, rounded
from marketloom.plans.forecast_queries import EDGE, LABEL, S, student_probabilities, targets
from marketloom.plans.relational_queries import BINS
from marketloom.plans.research_queries import rule_rows

HORIZON = 5
NAMES = ("climate", "persist", "student", "regime")
ALL = [f"{n}{k}" for n in NAMES for k in range(3)]
EXPERTS = ssql.expert_table(S, LABEL, EDGE, HORIZON)


def expert_table(spark, sf) -> DataFrame:
    """symbol, day, y (class of the next five days) and four forecasts of it that
    use only outcomes seen before the row's block of 21."""
    t = targets(spark, sf).where("band is not null and sigma is not null")
    y = forecast.label(F.col("rh"), F.col("band") * F.sqrt(F.lit(5.0)))
    rows = student_probabilities(t).select("symbol", "day", "sigma", F.col("regime").cast("int").alias("regime"), y.alias("y"), *[F.col(f"p{k}").alias(f"student{k}") for k in range(3)])
    rows = rows.withColumn("prev", F.coalesce(F.lag("y", HORIZON).over(ind.w()), F.lit(-1)))
    rows = experts.place_in_blocks(rows, HORIZON, burn=250, every=21)
    for name, by in (("climate", []), ("persist", ["prev"]), ("regime", ["regime"])):
        rows = experts.past_rates(rows, "y", by, name)
    return rows.where("block > 0").select("symbol", "day", "sigma", "regime", "prev", "y", *ALL)


@query("p305_308_experts", EXPERTS + f" select symbol, day, y, {', '.join(f'round({c}, 6) as {c}' for c in ALL)} from experts")
def all_experts(spark, sf):
    return rounded(expert_table(spark, sf).select("symbol", "day", "y", *ALL))


@query("p310_expert_mixture", ssql.expert_mixture(EXPERTS, NAMES, HORIZON))
def expert_mixture(spark, sf):
    """Fixed-share mixture of the experts; a loss counts once its outcome is five rows old."""

    def f(y, *p):
        shape = np.stack(p, 1).reshape(len(y), len(NAMES), 3).transpose(1, 0, 2)
        mixed, weights = recursive.share_experts(shape, np.where(np.isnan(y), -1, y).astype(int), delay=HORIZON, share=0.01)
        return {**{f"p{k}": mixed[:, k] for k in range(3)}, **{f"w_{n}": weights[:, i] for i, n in enumerate(NAMES)}}

    rows = expert_table(spark, sf).withColumn("y", F.col("y").cast("double"))
    return rounded(ind.per_symbol(rows, ["y", *ALL], dict.fromkeys([*[f"p{k}" for k in range(3)], *[f"w_{n}" for n in NAMES]], "double"), f))


def scored(rows: DataFrame, probability) -> list:
    p = [F.col(probability)[k] if isinstance(probability, str) else probability[k] for k in range(3)]
    return [scoring.log_score(scoring.picked(F.col("y"), p)), scoring.brier(F.col("y"), p)]


def _against_climate(rows: DataFrame, name: str) -> DataFrame:
    """One row: log score and Brier of an ML model's probabilities and of climatology, after the training span."""
    from pyspark.ml.functions import vector_to_array

    later = rows.withColumn("p", vector_to_array("probability")).where("y is not null and not train")
    own, base = scored(later, "p"), scored(later, [F.col(f"climate{k}") for k in range(3)])
    return later.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), F.avg(own[0]).alias("log_score"), F.avg(base[0]).alias("climate_log_score"), F.avg(own[1]).alias("brier"), F.avg(base[1]).alias("climate_brier"))


def _labelled(spark, sf) -> DataFrame:
    rows = expert_table(spark, sf).withColumn("train", F.col("day") < F.lit("1999-10-13").cast("date"))
    # An outcome is seen five rows later: the last training rows' reach beyond the span.
    seen = F.coalesce(F.lead("train", HORIZON).over(ind.w()), F.lit(False))
    return rows.withColumns({"label": F.when(F.col("train") & seen, F.col("y").cast("double"))}).checkpoint()


@query("p313_expert_stack")
def expert_stack(spark, sf):
    """A meta-learner on the experts' forecasts, which never saw the outcomes they forecast."""
    rows = _labelled(spark, sf)
    model = experts.fit_stack(rows, ALL, "label")
    return rounded(_against_climate(model.transform(experts.stack_vector(rows, ALL)), "stack"))


@query("p313_rule_ensemble")
def rule_ensemble(spark, sf):
    """Paths of a forest as rules, chosen by an L1 penalty."""
    rows = _labelled(spark, sf).withColumn("dow", F.weekday("day").cast("double"))
    features = ["sigma", "regime", "prev", "dow", "student0", "student2", "regime0", "regime2"]
    model, rules = experts.fit_rule_ensemble(rows, features, "label")
    kept = int((np.abs(model.coefficientMatrix.toArray()[:, : len(rules)]).max(0) > 0).sum()) if rules else 0
    out = _against_climate(model.transform(experts.rule_vector(rows, rules, features)), "rules")
    return rounded(out.withColumns({"rules": F.lit(len(rules)), "rules_kept": F.lit(kept)}))


@query("scr10_bootstrap_skill", ssql.bootstrapped_skill(EXPERTS))
def bootstrap_skill(spark, sf):
    """95 % intervals of the regime forecast's skill over climatology, of what it
    gains on Student's classes row by row, and of the area for rises against falls with persistence beside it."""
    brier = lambda n: scoring.brier(F.col("y"), [F.col(f"{n}{k}") for k in range(3)])
    rows = expert_table(spark, sf).where("y is not null")
    rows = rows.select("symbol", "day", brier("climate").alias("base"), brier("regime").alias("own"), brier("student").alias("other"), (F.col("persist2") - F.col("persist0") + F.col("regime2") - F.col("regime0")).alias("up"), F.col("y").cast("double").alias("y"))
    skill = lambda own, base: 1 - own.mean() / base.mean()
    gain = lambda own, other, base: (other.mean() - own.mean()) / base.mean()
    area = lambda up, y: experts.rank_auc(up[y != 1], y[y != 1] / 2)
    made = {"skill": (["own", "base"], skill), "gain": (["own", "other", "base"], gain), "area": (["up", "y"], area)}
    out = None
    for name, (columns, f) in made.items():
        one = scoring.interval(scoring.bootstrap(rows, columns, f, 200, 20)).withColumn("measure", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("rul04_08_four_gates", ssql.four_gates(BINS, 100, 20))
def four_gates(spark, sf):
    """Every rule and class, and how many gates it passes; rules about busy days alone restate the base."""
    rows, features = rule_rows(spark, sf)
    rows = rows.withColumn("train", F.col("day") < F.lit("1999-10-13").cast("date"))
    return rounded(gates.four_gates(rows, features, "bin", "nb", ("busy",)), 6, z=5, t=4, z_later=5)
