"""Token interventions: discrepancies, critical positions, candidates, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from robusteval.functions.keys import as_column


def discrepancy(logits, actual) -> Column:
    """Probability of the likeliest token less that of the actual one, under softmax."""
    v = as_column(logits)
    top = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return (1 - F.exp(F.get(v, as_column(actual)) - top)) / total


def top_tokens(logits, k: int) -> Column:
    """Token ids of the k largest logits; equal ones in order of id."""
    v = as_column(logits)
    pairs = F.transform(v, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def position_scores(rows: DataFrame) -> DataFrame:
    """(item, position, score): the largest discrepancy over forms."""
    return rows.groupBy("item", "position").agg(F.max(F.round(discrepancy("logits", "actual"), 9)).alias("score"))


def critical(scores: DataFrame, special: DataFrame | None = None) -> DataFrame:
    """(item, critical_position, critical_score): the highest score, first if equal.
    special (item, position) can't be chosen."""
    rows = scores if special is None else scores.join(special, ["item", "position"], "left_anti")
    best = rows.groupBy("item").agg(F.max(F.struct("score", (-F.col("position")).alias("p"))).alias("b"))
    return best.select("item", (-F.col("b.p")).alias("critical_position"), F.col("b.score").alias("critical_score"))


def candidates(actual, top, k: int) -> Column:
    """The actual token first, then the top ones, each once, k in all."""
    return F.slice(F.array_distinct(F.concat(F.array(as_column(actual)), as_column(top))), 1, k)


def rollout_grid(rows: DataFrame, forms: list[str]) -> DataFrame:
    """Candidates times forms, numbered, without a join."""
    listed = F.array(*[F.lit(f) for f in forms])
    each = rows.select("*", F.posexplode("candidates").alias("candidate_index", "candidate_token"))
    return each.select("*", F.posexplode(listed).alias("form_index", "form_id")).drop("candidates")


def similarity(rows: DataFrame) -> DataFrame:
    """(item, form_id, weight): cosine to the item's original form, at least zero; the
    original weighs one. rows: (item, form_id, is_original, v)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = rows.filter("is_original").select("item", F.col("v").alias("o"))
    cosine = F.try_divide(dot(F.col("v"), F.col("o")), F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("o"), F.col("o"))))
    weight = F.when(F.col("is_original"), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), cosine))
    return rows.join(own, "item").select("item", "form_id", weight.alias("weight"))


def select_rollout(rollouts: DataFrame) -> DataFrame:
    """(item, selected_index, selected_answer, consistency): the rollout whose answer
    gathers most weight; then the answer first as text (none reads 'None'), then
    the first. rollouts: (item, rollout_index, parsed_answer, weight)."""
    per = rollouts.groupBy("item", "parsed_answer").agg(F.round(F.sum("weight"), 9).alias("w"), F.min("rollout_index").alias("i"))
    score = F.when(F.col("parsed_answer").isNull(), F.lit(0.0)).otherwise(F.col("w"))
    key = F.struct((-score).alias("s"), F.coalesce("parsed_answer", F.lit("None")).alias("t"), F.col("i"), F.col("parsed_answer").alias("a"))
    best = per.groupBy("item").agg(F.min(key).alias("b"))
    return best.select("item", F.col("b.i").alias("selected_index"), F.col("b.a").alias("selected_answer"), (-F.col("b.s")).alias("consistency"))


def plain_majority(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, sc_majority, sc_correctness): the commonest answer, first as text if equal."""
    counts = rows.groupBy(*by, "parsed_answer").agg(F.count("*").alias("c"), F.count_if("correctness").alias("yes"), F.count("correctness").alias("decided"))
    key = F.when(F.col("parsed_answer").isNotNull(), F.struct((-F.col("c")).alias("c"), F.col("parsed_answer").alias("a"), "yes", "decided"))
    unanswered = F.when(F.col("parsed_answer").isNull(), F.struct("yes", "decided"))
    best = counts.groupBy(*by).agg(F.min(key).alias("b"), F.max(unanswered).alias("u"))
    yes, decided = F.coalesce("b.yes", "u.yes"), F.coalesce("b.decided", "u.decided")
    correct = F.when(decided > 0, yes * 2 >= decided)
    return best.select(*by, F.col("b.a").alias("sc_majority"), correct.alias("sc_correctness"))


def left_pad(ids, width: int, pad_id: int) -> Column:
    """Token ids padded on the left to a width."""
    v = as_column(ids)
    return F.concat(F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), width - F.size(v))), v)


def summarize(rows: DataFrame) -> DataFrame:
    """One row of means, differences and conditional subsets. rows: (item_id,
    correctness, initial_correctness, sc_correctness, sc_disagrees, ppcv_output_tokens,
    sc_output_tokens, probe_seconds, ppcv_seconds)."""
    y = lambda c: F.col(c).cast("int").cast("double")
    wrong = F.coalesce(~F.col("initial_correctness"), F.lit(False))
    split = F.coalesce("sc_disagrees", F.lit(False))
    out = rows.agg(
        F.count("*").alias("n"),
        F.avg(y("correctness")).alias("ppcv_accuracy"),
        F.avg(y("sc_correctness")).alias("sc_accuracy"),
        F.count_if(wrong).alias("baseline_error_n"),
        F.avg(F.when(wrong, y("correctness"))).alias("baseline_error_accuracy"),
        F.count_if(split).alias("disagreement_n"),
        F.avg(F.when(split, y("correctness"))).alias("disagreement_ppcv_accuracy"),
        F.avg(F.when(split, y("sc_correctness"))).alias("disagreement_sc_accuracy"),
        F.avg("ppcv_output_tokens").alias("mean_ppcv_output_tokens"),
        F.avg("sc_output_tokens").alias("mean_sc_output_tokens"),
        F.avg("probe_seconds").alias("mean_probe_seconds"),
        F.avg("ppcv_seconds").alias("mean_ppcv_seconds"),
        F.percentile("ppcv_seconds", 0.95).alias("p95_ppcv_seconds"),
    )
    return out.withColumn("ppcv_minus_sc", F.col("ppcv_accuracy") - F.col("sc_accuracy"))


def first_by(rows: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each group in an order with its tie-breaks."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("__r = 1").drop("__r")
