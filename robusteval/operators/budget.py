"""Comparisons at an equal number of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reference_budgets(rows: DataFrame, method: str = "sc_8") -> DataFrame:
    """(dataset, item_id, cap): what the reference method spent on each item."""
    own = rows.filter((F.col("mode") == "non_thinking") & (F.col("method") == method))
    return own.groupBy("dataset", "item_id").agg(F.sum("output_tokens").alias("cap"))


def token_match(rows: DataFrame, method: str = "sc_8") -> DataFrame:
    """The rows of fixed-budget methods that fit the reference's spend per item.

    Rows enter in order of form, sample and seed; the first always, each later one
    if it still fits, else it is passed over. The fold is over one item's samples.
    A data set without the reference has no result; an item without it is an error.
    """
    fixed = rows.filter("mode = 'non_thinking' and (method like 'sc\\_%' or method like 'scop\\_%')")
    caps = reference_budgets(rows, method)
    known = caps.select("dataset").distinct()
    fixed = fixed.join(known, "dataset", "left_semi").join(caps, ["dataset", "item_id"], "left")
    cap = F.when(F.col("cap").isNull(), F.raise_error(F.lit("an item has no reference budget"))).otherwise(F.col("cap"))
    rest = [c for c in rows.columns if c not in ("dataset", "item_id", "mode", "method", "form_id", "sample_index", "seed")]
    row = F.struct("form_id", F.coalesce("sample_index", F.lit(0)).alias("place"), "seed", "sample_index", *rest)
    groups = fixed.groupBy("dataset", "item_id", "mode", "method").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max(cap).alias("cap"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, r: Column) -> Column:
        fits = (F.size(a["kept"]) == 0) | (a["spent"] + r["output_tokens"] <= F.col("cap"))
        return F.struct(
            (a["spent"] + F.when(fits, r["output_tokens"]).otherwise(F.lit(0))).cast("long").alias("spent"),
            (a["at"] + 1).alias("at"),
            F.when(fits, F.concat(a["kept"], F.array(a["at"]))).otherwise(a["kept"]).alias("kept"),
        )

    kept = groups.withColumn("kept", F.aggregate("rows", start, step, lambda a: a["kept"]))
    chosen = F.filter("rows", lambda r, i: F.array_contains(F.col("kept"), i))
    return kept.select("dataset", "item_id", "mode", "method", F.inline(chosen)).drop("place")
