"""Votes, robustness, variance, calibration, error detection and costs.

Operators take scored rows and group them by ``by`` (for example data set, mode
and method); every one is a fixed number of aggregations whose map sides combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval.operators.order import quantiles, ranked

BY = ["dataset", "mode", "method"]


def number(flag: Column | str) -> Column:
    """A boolean as 1.0 or 0.0; null stays null."""
    return (F.col(flag) if isinstance(flag, str) else flag).cast("int").cast("double")


def votes(rows: DataFrame, by: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, majority_answer, confidence, majority_correct, n_right, n_decided,
    entropy, sums): a group's vote, verdicts, entropy and totals, from one pass.

    Ties go to the larger sum of log probabilities, then to the first in text
    order. Rows without an answer don't vote but count in the confidence. One
    aggregation by answer, one by group: no window, no sort of a group.
    """
    counts = rows.groupBy(*by, "parsed_answer").agg(
        F.count("*").alias("c"),
        F.round(F.sum(F.coalesce("normalized_log_probability", F.lit(0.0))), 9).alias("lp"),
        F.count_if("correctness").alias("yes"),
        F.count("correctness").alias("decided"),
        *[F.sum(c).alias(c) for c in sums],
    )
    known = F.col("parsed_answer").isNotNull()
    best = counts.groupBy(*by).agg(
        F.sum("c").alias("n"),
        F.max(F.when(known, F.struct("c", "lp"))).alias("top"),
        F.collect_list(F.when(known, F.struct("parsed_answer", "c", "lp", "yes", "decided"))).alias("all"),
        F.sum("yes").alias("n_right"),
        F.sum("decided").alias("n_decided"),
        F.sum(F.when(known, F.col("c"))).alias("given"),
        F.sum(F.when(known, F.col("c") * F.log("c"))).alias("spread"),
        *[F.sum(c).alias(c) for c in sums],
    )
    tied = F.filter("all", lambda v: (v["c"] == F.col("top")["c"]) & (v["lp"] == F.col("top")["lp"]))
    out = best.withColumn("w", F.array_min(tied))
    return out.select(
        *by,
        "n",
        F.col("w.parsed_answer").alias("majority_answer"),
        F.when(F.col("w").isNotNull(), F.col("w.c") / F.col("n")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("w.decided") > 0, F.col("w.yes") * 2 >= F.col("w.decided")).alias("majority_correct"),
        "n_right",
        "n_decided",
        (F.log("given") - F.col("spread") / F.col("given")).alias("entropy"),
        *sums,
    )


def majority(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, majority_answer, confidence, majority_correct) by vote."""
    return votes(rows, by).select(*by, "n", "majority_answer", "confidence", "majority_correct")


def item_forms(rows: DataFrame, by: list[str] = BY) -> DataFrame:
    """Per item and form: the vote, solve rate and run variance (of zeros and ones)."""
    p = F.try_divide("n_right", "n_decided")
    keys = [*by, "item_id", "form_id"]
    return votes(rows, keys).select(*keys, p.alias("solve_rate"), (p * (1 - p)).alias("run_variance"), "n", "majority_answer", "confidence", "majority_correct", "n_right", "n_decided")


def item_robustness(forms: DataFrame, by: list[str] = BY) -> DataFrame:
    """Per item: robust, worst form, flips and mean correctness. Robust needs every
    form that its group has, decided and right."""
    known = [k for k in by if k in forms.columns]
    total = forms.groupBy(*known).agg(F.count_distinct("form_id").alias("n_forms"))
    items = forms.groupBy(*by, "item_id").agg(
        F.count("majority_correct").alias("n_decided"),
        F.coalesce(F.every("majority_correct"), F.lit(False)).alias("all_right"),
        F.min("solve_rate").alias("worst_form_solve_rate"),
        F.count_distinct("majority_answer").alias("n_answers"),
        F.count_distinct("majority_correct").alias("n_verdicts"),
        F.avg("solve_rate").alias("mean_correctness"),
        F.var_pop("solve_rate").alias("form_variance"),
    )
    return items.join(total, known).select(
        *by,
        "item_id",
        (F.col("all_right") & (F.col("n_decided") == F.col("n_forms"))).alias("robust"),
        "worst_form_solve_rate",
        (F.col("n_answers") > 1).alias("answer_flip"),
        (F.col("n_verdicts") > 1).alias("correctness_flip"),
        "mean_correctness",
        "form_variance",
    )


def variance(forms: DataFrame, by: list[str] = BY) -> DataFrame:
    """(by, v_run, v_form, v_item, pi_form)."""
    run = forms.groupBy(*by).agg(F.avg("run_variance").alias("v_run"))
    items = forms.groupBy(*by, "item_id").agg(F.var_pop("solve_rate").alias("f"), F.avg("solve_rate").alias("m"))
    rest = items.groupBy(*by).agg(F.avg("f").alias("v_form"), F.var_pop("m").alias("v_item"))
    total = F.col("v_run") + F.col("v_form") + F.col("v_item")
    return run.join(rest, by).withColumn("pi_form", F.when(total > 0, F.col("v_form") / total).otherwise(F.lit(0.0)))


def main_metrics(rows: DataFrame, by: list[str] = BY) -> DataFrame:
    """One row per group of main runs: accuracies, robustness, flips, variances."""
    forms, original = item_forms(rows, by), F.col("form_id") == "original"

    def share(where: Column) -> Column:
        return F.try_divide(F.sum(F.when(where, F.col("n_right"))), F.sum(F.when(where, F.col("n_decided"))))

    accuracy = forms.groupBy(*by).agg(
        share(F.lit(True)).alias("mean_accuracy"),
        share(original).alias("original_accuracy"),
        share(~original).alias(C.REWORDED_ACCURACY),
    )
    items = item_robustness(forms, by).groupBy(*by).agg(
        F.avg(number("robust")).alias("robust_accuracy"),
        F.avg("worst_form_solve_rate").alias("worst_form_accuracy"),
        F.avg(number("answer_flip")).alias("answer_flip_rate"),
        F.avg(number("correctness_flip")).alias("correctness_flip_rate"),
    )
    return accuracy.join(items, by).join(variance(forms, by), by)


LAYERS = [("raw", "raw_exact_match"), ("normalized", "normalized_match"), ("symbolic_pre_judge", "canonical_match")]


def layers(rows: DataFrame) -> DataFrame:
    """rows once per layer with that layer's verdict as correctness, undecided
    ones left out: one pass instead of one per layer."""
    each = F.array(*[F.struct(F.lit(name).alias("layer"), F.col(column).alias("verdict")) for name, column in LAYERS])
    kept = [c for c in rows.columns if c != "correctness"]
    return rows.select(*kept, F.inline(each)).filter("verdict is not null").withColumnRenamed("verdict", "correctness")


def layer_metrics(rows: DataFrame, by: list[str] = BY) -> DataFrame:
    out = main_metrics(layers(rows), [*by, "layer"])
    return out.select(*by, "layer", F.col("mean_accuracy").alias("accuracy"), "robust_accuracy", "correctness_flip_rate", "pi_form")


def entropy(rows: DataFrame, by: list[str]) -> DataFrame:
    """Entropy of the answers that were given, in nats; groups without one are left out."""
    return votes(rows, by).filter("entropy is not null").select(*by, "entropy")


def item_votes(rows: DataFrame, by: list[str] = BY) -> DataFrame:
    """Per item: vote, entropy and the tokens and seconds spent."""
    return votes(rows, [*by, "item_id"], ("input_tokens", "output_tokens", "gpu_seconds"))


def calibration_rows(votes: DataFrame, by: list[str] = BY) -> DataFrame:
    return votes.filter("majority_correct is not null").select(*by, "item_id", F.col("confidence").alias("c"), number("majority_correct").alias("y"), "entropy")


def ece_fixed(rows: DataFrame, by: list[str] = BY, bins: int = C.ECE_BINS) -> DataFrame:
    """Expected calibration error over equal bins, closed on the left, the last on
    both sides; edges are the floating point values i * (1 / bins)."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    place = F.size(F.filter(edges, lambda e: e <= F.col("c")))
    return _ece(rows.withColumn("bin", place), by, "ece_fixed")


def ece_adaptive(rows: DataFrame, by: list[str] = BY, bins: int = C.ECE_BINS) -> DataFrame:
    """The same over bins of equal count in order of confidence (ties by item). Places
    come from counts by range, so no task orders a whole group."""
    placed = ranked(rows.select(*by, "c", "y", "item_id"), by, ["c", "item_id"])
    k = F.least(F.lit(bins), F.col("n"))
    size, more = F.floor(F.col("n") / k), F.col("n") % k
    cut = more * (size + 1)
    place = F.when(F.col("pos") < cut, F.floor(F.col("pos") / (size + 1))).otherwise(more + F.floor((F.col("pos") - cut) / size))
    return _ece(placed.withColumn("bin", place), by, "ece_adaptive")


def _ece(binned: DataFrame, by: list[str], name: str) -> DataFrame:
    per = binned.groupBy(*by, "bin").agg(F.count("*").alias("m"), F.abs(F.avg("c") - F.avg("y")).alias("gap"))
    return per.groupBy(*by).agg((F.sum(F.col("m") * F.col("gap")) / F.sum("m")).alias(name))


def brier(rows: DataFrame, by: list[str] = BY) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col("c") - F.col("y"), 2)).alias("brier_score"))


def auroc(rows: DataFrame, by: list[str], score: Column, name: str) -> DataFrame:
    """Area under the curve of detecting wrong answers by a score; null if all are
    right or all wrong. Equal scores are counted first, so only distinct scores
    are ordered."""
    s = rows.select(*by, F.round(score, 12).alias("s"), (1 - F.col("y")).alias("wrong"))
    counts = s.groupBy(*by, "s").agg(F.sum("wrong").alias("p"), F.sum(1 - F.col("wrong")).alias("q"))
    below = F.coalesce(F.sum("q").over(W.partitionBy(*by).orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ranked = counts.withColumn("below", below)
    pairs = F.sum("p") * F.sum("q")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), pairs).alias(name))


def fixed_budget(rows: DataFrame, by: list[str] = BY, bins: int = C.ECE_BINS) -> DataFrame:
    """One row per group of fixed-budget runs: accuracy, calibration, costs, detection."""
    votes = item_votes(rows, by)
    cal = calibration_rows(votes, by)
    base = votes.filter("majority_correct is not null").groupBy(*by).agg(
        F.avg(number("majority_correct")).alias("final_accuracy"),
        *[F.avg(c).alias(f"mean_{c}_per_item") for c in ("input_tokens", "output_tokens", "gpu_seconds")],
    )
    out = base.join(brier(cal, by), by).join(ece_fixed(cal, by, bins), by).join(ece_adaptive(cal, by, bins), by)
    out = out.join(auroc(cal, by, 1 - F.col("c"), "auroc_disagreement"), by)
    return out.join(auroc(cal, by, F.col("entropy"), "auroc_entropy"), by)


def costs(rows: DataFrame, by: list[str] = BY) -> DataFrame:
    """Totals, means per item and rates of every group, decided or not."""
    items = F.count_distinct("item_id")
    flag = lambda c, absent=False: F.avg(number(F.coalesce(F.col(c), F.lit(absent))))
    blank = F.coalesce(F.trim("raw_output") == "", F.lit(True)) if "raw_output" in rows.columns else F.lit(False)
    failed = blank | ~F.coalesce(F.col("finish_reason").isin("stop", "length"), F.lit(False))
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(f"total_{c}") for c in ("input_tokens", "output_tokens", "gpu_seconds")]
    peak = F.max("peak_gpu_memory_gib") if "peak_gpu_memory_gib" in rows.columns else F.lit(None).cast("double")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        items.alias("n_items"),
        *sums,
        flag("raw_exact_match").alias("raw_exact_accuracy"),
        flag("normalized_match").alias("normalized_parser_accuracy"),
        F.avg(number("canonical_match")).alias("symbolic_pre_judge_accuracy"),
        flag("judge_required").alias("judge_adjudication_rate"),
        (1 - flag("answer_format_ok")).alias("answer_format_violation_rate"),
        flag("truncated").alias("truncation_rate"),
        F.avg(number(failed)).alias("generation_failure_rate"),
        peak.alias("peak_gpu_memory_gib"),
    )
    means = [(F.col(f"total_{c}") / F.col("n_items")).alias(f"mean_{c}_per_item") for c in ("input_tokens", "output_tokens", "gpu_seconds")]
    return out.select("*", *means)


def latency(rows: DataFrame, by: list[str] = BY) -> DataFrame:
    """Mean and exact 95th percentile of the latency summed per item; the percentile
    is read off the items' places, without a buffer of a group's values."""
    per = rows.groupBy(*by, "item_id").agg(F.sum(F.coalesce("latency_seconds", F.lit(0.0))).alias("s"))
    means = per.groupBy(*by).agg(F.avg("s").alias("mean_latency_seconds_per_item"))
    return means.join(quantiles(per, by, "s", {"p95_latency_seconds_per_item": 0.95}), by)


def efficiency(accuracies: DataFrame, spent: DataFrame, by: list[str] = BY) -> DataFrame:
    """Accuracy per million tokens and per GPU hour, null where nothing was spent."""
    both = accuracies.join(spent, by)
    tokens, seconds = F.col("mean_output_tokens_per_item"), F.col("mean_gpu_seconds_per_item")
    per = lambda x, scale, cost: F.when(cost > 0, F.col(x) * scale / cost)
    return both.select(
        *by,
        per("accuracy", 1_000_000, tokens).alias("accuracy_per_million_generated_tokens"),
        per("accuracy", 3600, seconds).alias("accuracy_per_gpu_hour"),
        per("robust_accuracy", 3600, seconds).alias("robust_accuracy_per_gpu_hour"),
    )


def throughput(rows: DataFrame, responses_per_item: int, by: list[str], tokens_per_second: float | None = None) -> DataFrame:
    """How many items a job of eight hours holds at the rate seen (or one given)."""
    rate = F.try_divide(F.sum("output_tokens"), F.sum("gpu_seconds")) if tokens_per_second is None else F.lit(tokens_per_second)
    out = rows.groupBy(*by).agg(F.avg("output_tokens").alias("mean_output_tokens"), rate.alias("tokens_per_second"))
    n_max = F.floor(F.lit(0.70 * 28_800) * F.col("tokens_per_second") / (F.col("mean_output_tokens") * responses_per_item))
    return out.withColumn("n_max", n_max.cast("long"))


def pareto(points: DataFrame, cost: str = "tokens", gain: str = "accuracy", by: list[str] | None = None) -> DataFrame:
    """points with on_frontier: no cheaper or equally cheap point is better."""
    w = W.partitionBy(*(by or [])).orderBy(cost, F.desc(gain)).rowsBetween(W.unboundedPreceding, -1)
    before = F.max(gain).over(w)
    return points.withColumn("on_frontier", before.isNull() | (F.col(gain) > before))
