"""Paired tests, step-down correction, intervals; resampling is in resample.py."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from robusteval import constants as C


def item_variances(forms: DataFrame, by: list[str]) -> DataFrame:
    """Per item: mean run variance, form variance, mean solve rate."""
    return forms.filter("solve_rate is not null").groupBy(*by, "item_id").agg(
        F.avg("run_variance").alias("run"), F.var_pop("solve_rate").alias("form"), F.avg("solve_rate").alias("item_mean")
    )


def paired(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """(on, left_value, right_value) of the keys both have."""
    a = left.select(*on, F.col(value).alias("left_value"))
    return a.join(right.select(*on, F.col(value).alias("right_value")), on)


def binomial_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c under even odds; 1 if neither occurs. Terms
    are summed from the smallest power, in logarithms, so large counts hold."""
    n, k = b + c, F.least(b, c)
    start = F.struct((-F.lit(float(np.log(2))) * n).alias("t"), F.exp(-F.lit(float(np.log(2))) * n).alias("s"))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i)).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i))).alias("s"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, start, step, lambda a: a["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), 2 * tail), 9))


def mcnemar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, left_only, right_only, pvalue, effect) of paired booleans."""
    left, right = F.col("left_value"), F.col("right_value")
    out = pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(left & ~right).alias("left_only"),
        F.count_if(~left & right).alias("right_only"),
    )
    effect = (F.col("left_only") - F.col("right_only")) / F.col("n")
    return out.withColumn("pvalue", binomial_p(F.col("left_only"), F.col("right_only"))).withColumn("effect", effect)


def compare_modes(items: DataFrame) -> DataFrame:
    """Thinking against non-thinking, robust items of the main run, per data set."""
    main = items.filter("method = 'main'")
    pairs = paired(main.filter("mode = 'thinking'"), main.filter("mode = 'non_thinking'"), ["dataset", "item_id"], "robust")
    out = mcnemar(pairs, ["dataset"])
    return out.select(F.concat("dataset", F.lit(": thinking vs non_thinking robust correctness")).alias("comparison"), "n", "left_only", "right_only", "pvalue", "effect")


def compare_methods(votes: DataFrame) -> DataFrame:
    """All pairs of fixed-budget methods on the items both decide, per data set."""
    fixed = votes.filter("mode = 'non_thinking' and (method like 'sc\\_%' or method like 'scop\\_%') and majority_correct is not null")
    rows = fixed.select("dataset", "item_id", "method", "majority_correct")
    a = rows.select("dataset", "item_id", F.col("method").alias("left_method"), F.col("majority_correct").alias("left_value"))
    b = rows.select("dataset", "item_id", F.col("method").alias("right_method"), F.col("majority_correct").alias("right_value"))
    pairs = a.join(b, ["dataset", "item_id"]).filter("left_method < right_method")
    out = mcnemar(pairs, ["dataset", "left_method", "right_method"])
    name = F.concat("dataset", F.lit(": "), "left_method", F.lit(" vs "), "right_method", F.lit(" final correctness"))
    return out.select(name.alias("comparison"), "n", "left_only", "right_only", "pvalue", "effect")


def holm(tests: DataFrame, pvalue: str = "pvalue", by: list[str] | None = None) -> DataFrame:
    """tests with holm_adjusted_pvalue: step-down over a family of tests (a small
    report, one row per comparison). A null p-value leaves all unadjusted."""
    family = W.partitionBy(*(by or []))
    ordered = tests.withColumn("__rank", F.row_number().over(family.orderBy(pvalue)) - 1)
    ordered = ordered.withColumn("__m", F.count("*").over(family)).withColumn("__known", F.count(pvalue).over(family))
    step = F.least(F.lit(1.0), (F.col("__m") - F.col("__rank")) * F.col(pvalue))
    running = F.max(step).over(family.orderBy("__rank").rowsBetween(W.unboundedPreceding, 0))
    return ordered.withColumn("holm_adjusted_pvalue", F.when(F.col("__m") == F.col("__known"), running)).drop("__rank", "__m", "__known")


def wilson(successes: Column, total: Column, z: float = C.Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval within 0 and 1; (0, 0) of nothing."""
    n = F.nullif(total, F.lit(0))
    p = F.try_divide(successes, total)
    scale = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / scale
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / scale
    low = F.when(total > 0, F.greatest(F.lit(0.0), centre - spread)).otherwise(F.lit(0.0))
    high = F.when(total > 0, F.least(F.lit(1.0), centre + spread)).otherwise(F.lit(0.0))
    return low, high
