"""Judgments on scores, audits and the gates before a result counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval.operators import keysets, stats
from robusteval.operators.metrics import number


def apply_judgments(scored: DataFrame, judged: DataFrame, keys: list[str], order: str = "position") -> DataFrame:
    """scored with the last judgment of each key: a decided one sets correctness, an
    uncertain or unreadable one makes it null; rows without one stay."""
    last = keysets.latest(judged.select(*keys, order, "parse_ok", "equivalent", "uncertain"), keys, order).drop(order)
    decided = F.coalesce(F.col("parse_ok") & ~F.col("uncertain"), F.lit(False))
    out = scored.join(last.withColumn("__judged", F.lit(True)), keys, "left")
    correctness = F.when(F.col("__judged").isNull(), F.col("correctness")).when(decided, F.col("equivalent"))
    status = F.when(F.col("__judged").isNull(), F.col("judge_status")).when(decided, "decided").otherwise("uncertain")
    return out.withColumn("correctness", correctness).withColumn("judge_status", status).drop("parse_ok", "equivalent", "uncertain", "__judged")


def queue(scored: DataFrame, judged: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows that still wait for a judge."""
    rows = scored.filter(F.coalesce("judge_required", F.lit(False)) & (F.col("judge_status") == "pending"))
    return rows if judged is None else rows.join(judged.select(*keys), keys, "left_anti")


def guard_decided(rows: DataFrame) -> DataFrame:
    """One row: counts and whether an analysis may start."""
    out = rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("correctness").isNull()).alias("n_undecided"))
    return out.withColumn("may_analyze", (F.col("n_rows") > 0) & (F.col("n_undecided") == 0))


def audit_report(rows: DataFrame) -> DataFrame:
    """One row: equivalence rate with its interval, and whether the audit passes."""
    known = F.col("equivalence").isin("equivalent", "not_equivalent", "uncertain")
    labelled = F.col("transformation_label_correct").isin("yes", "no", "uncertain")
    n = rows.agg(
        F.count("*").alias("audited_pairs"),
        F.count_if(F.col("equivalence") != "uncertain").alias("decided_pairs"),
        F.count_if(F.col("equivalence") == "equivalent").alias("equivalent_pairs"),
        F.count_if(F.col("equivalence") == "uncertain").alias("uncertain_pairs"),
        F.count_if(~F.coalesce(known & labelled, F.lit(False))).alias("invalid_rows"),
    )
    low, high = stats.wilson(F.col("equivalent_pairs"), F.col("decided_pairs"))
    n = n.withColumn("equivalence_rate", F.coalesce(F.try_divide("equivalent_pairs", "decided_pairs"), F.lit(0.0)))
    n = n.withColumn("wilson_low", low).withColumn("wilson_high", high)
    passed = (F.col("equivalence_rate") >= C.MIN_EQUIVALENCE) & (F.col("uncertain_pairs") == 0) & (F.col("invalid_rows") == 0)
    return n.withColumn("passed", passed)


def result_gates(rows: DataFrame, keys: list[str], by: list[str], progress: DataFrame | None = None) -> DataFrame:
    """(by, gate, value, allowed, failed): duplicates, truncation, undecided, format
    and, with progress (by, completed, expected), completeness, from two aggregations."""
    one = rows.groupBy(*by).agg(
        F.avg(number(F.coalesce("truncated", F.lit(False)))).alias("truncation_rate"),
        F.avg(number(F.col("correctness").isNull())).alias("undecided_rate"),
        F.avg(number(~F.coalesce("answer_format_ok", F.lit(False)))).alias("format_violation_rate"),
    )
    repeated = rows.groupBy(*by, *[k for k in keys if k not in by]).agg(F.count("*").alias("c")).groupBy(*by).agg(F.sum(F.col("c") - 1).cast("double").alias("duplicate_keys"))
    allowed = [("duplicate_keys", float(C.MAX_DUPLICATES)), ("truncation_rate", C.MAX_TRUNCATION), ("undecided_rate", C.MAX_UNDECIDED), ("format_violation_rate", C.MAX_FORMAT_VIOLATIONS)]
    both = one.join(repeated, by)
    if progress is not None:
        short = F.col("expected") - F.col("completed")
        both = both.join(progress.select(*by, F.abs(short).cast("double").alias("incomplete_rows")), by, "left")
        both = both.withColumn("incomplete_rows", F.coalesce("incomplete_rows", F.lit(float("inf"))))
        allowed.append(("incomplete_rows", 0.0))
    each = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("value"), F.lit(a).alias("allowed")) for g, a in allowed])
    return both.select(*by, F.inline(each)).withColumn("failed", F.col("value") > F.col("allowed"))


def rewording_report(expected: DataFrame, rows: DataFrame, ratios: DataFrame, failed_gates: Column) -> DataFrame:
    """One row: whether the rewordings of a split are complete and sound."""
    keys = ["dataset", "item_id", "form_id"]
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        count(expected, "expected_pairs"),
        rows.agg(F.count("*").alias("accepted_pairs"), F.count_if(failed_gates).alias("failed_gate_count")),
        count(keysets.missing(expected, rows, keys), "missing_count"),
        count(keysets.unexpected(expected, rows, keys), "unexpected_count"),
        count(keysets.duplicates(rows, keys), "duplicate_count"),
        count(ratios.filter("below"), "shortened_count"),
    ]
    out = parts[0].withColumn("__one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("__one", F.lit(1)), "__one")
    bad = F.lit(0).cast("long")
    for c in ("missing_count", "unexpected_count", "duplicate_count", "failed_gate_count", "shortened_count"):
        bad = bad + F.col(c)
    return out.drop("__one").withColumn("passed", bad == 0)


def word_ratios(rows: DataFrame, ratio: Column) -> DataFrame:
    """Mean length ratio per transformation, with a mark on shortened ones."""
    out = rows.groupBy("transformation_type").agg(F.avg(ratio).alias("mean_ratio"))
    return out.withColumn("below", F.col("mean_ratio") < C.MIN_WORD_RATIO)
