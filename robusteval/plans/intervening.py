"""A whole intervention run: from the logits of trajectories to one chosen answer an
item, composed of the operators on discrepancies, candidates, rollouts and votes.

The model is outside: ``make`` builds it on a worker, and it gets one text a rollout, a
JSON object of the form's prompt and the token ids to begin with, and returns the text
of the whole response. Rollouts of an item are rows like any others, so an item's grid
of candidates and forms is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robusteval.functions import answers
from robusteval.operators import interventions
from robusteval.sources import files
from robusteval.streaming.resume import generate

Make = Callable[[], Callable[[list[str]], list[str]]]


def words(text: str) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")).cast("long")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder the machines share: what a model made isn't made again."""
    path = files.shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def answered(asked: DataFrame, make: Make, cost: Callable[[str], Column]) -> DataFrame:
    """asked (.., prompt, prefix, dataset, canonical_answer) with raw_output, the scored
    answer and output_tokens."""
    prompts = asked.withColumn("prompt_text", F.to_json(F.struct("prompt", "prefix")))
    made = kept(generate(prompts, make).drop("prompt_text"), "rollouts")
    return answers.score(made).withColumn("output_tokens", cost("raw_output"))


def run_items(trajectories: DataFrame, surfaces: DataFrame, make: Make, count: int = 11, samples: int = 0, special: DataFrame | None = None, cost: Callable[[str], Column] = words, shortest: int = 2) -> DataFrame:
    """One row an item: its critical position, the chosen rollout and answer with its
    consistency and verdict, the verdict of the untouched response if one is given, the
    plain vote of further samples, and the tokens spent.

    trajectories: (item, position, form_no, actual, logits), form 0 the original;
    surfaces: (item, form_no, form_id, prompt, dataset, canonical_answer, v), v the
    vector forms are weighed by. count: candidates with the actual token; samples: how
    often the original prompt is asked besides. A trajectory of fewer than ``shortest``
    tokens stops the run; one of a single token has its only position as the critical one.
    """
    own = trajectories.filter("form_no = 0").select("item", "position", "actual", "logits")
    length = own.groupBy("item").agg(F.count("*").alias("initial_tokens"))
    short = F.when(F.col("initial_tokens") < shortest, F.raise_error(F.concat(F.lit("too short a trajectory: "), "item"))).otherwise(F.col("initial_tokens"))
    critical = interventions.critical(interventions.position_scores(trajectories), special)
    before = own.join(critical, "item").filter(F.col("position") <= F.col("critical_position"))
    prefix = F.transform(F.array_sort(F.collect_list(F.when(F.col("position") < F.col("critical_position"), F.struct("position", "actual")))), lambda x: x["actual"])
    here = F.col("position") == F.col("critical_position")
    at = before.groupBy("item").agg(
        F.first("critical_position").alias("critical_position"),
        F.first("critical_score").alias("critical_score"),
        prefix.alias("begin"),
        F.max(F.when(here, F.col("actual"))).alias("actual"),
        F.max(F.when(here, F.col("logits"))).alias("logits"),
    )
    listed = interventions.candidates("actual", interventions.top_tokens("logits", count + 1), count)
    grid = at.select("item", "critical_position", "critical_score", "begin", F.posexplode(listed).alias("candidate_index", "candidate_token"))
    forms = surfaces.select("item", "form_no", "form_id", "prompt", "dataset", "canonical_answer")
    asked = grid.join(forms, "item").withColumn("prefix", F.concat("begin", F.array("candidate_token"))).drop("begin")
    width = surfaces.groupBy("item").agg(F.count("*").alias("n_forms"))
    rollouts = answered(asked, make, cost).join(width, "item").withColumn("rollout_index", (F.col("candidate_index") * F.col("n_forms") + F.col("form_no")).cast("long"))

    weights = interventions.similarity(surfaces.select("item", "form_id", (F.col("form_no") == 0).alias("is_original"), "v"))
    chosen = interventions.select_rollout(rollouts.join(weights, ["item", "form_id"]).select("item", "rollout_index", "parsed_answer", "weight"))
    verdicts = rollouts.select("item", F.col("rollout_index").alias("selected_index"), F.col("candidate_token").alias("selected_token"), F.col("form_id").alias("selected_form"), "correctness")
    spent = rollouts.groupBy("item").agg(F.count("*").alias("n_rollouts"), F.sum("output_tokens").alias("rollout_tokens"))
    out = at.select("item", "critical_position", "critical_score").join(length.select("item", short.cast("long").alias("initial_tokens")), "item")
    out = out.join(chosen, "item").join(verdicts, ["item", "selected_index"]).join(spent, "item")
    if samples:
        again = forms.filter("form_no = 0").withColumn("prefix", F.array().cast("array<int>"))
        again = again.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_index"))
        voted = answered(again.withColumn("prompt", F.concat("prompt", F.lit("\n#"), F.col("sample_index").cast("string"))), make, cost)
        disagree = voted.groupBy("item").agg((F.count_distinct("parsed_answer") > 1).alias("sc_disagrees"), F.sum("output_tokens").alias("sc_output_tokens"))
        out = out.join(interventions.plain_majority(voted, ["item"]), "item").join(disagree, "item")
    total = F.col("initial_tokens") + F.col("rollout_tokens")
    return out.withColumn("ppcv_output_tokens", total).drop("rollout_tokens")
