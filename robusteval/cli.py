"""Command line of the whole life cycle: prepare, generate, accept, validate, preflight,
plan, infer, score, judge, analyze, gates, audits, interventions, artifacts, capacity.

``python -m robusteval.cli COMMAND --help`` lists a command's options. Tables are
read by extension: .jsonl and .json as JSON lines, .csv as CSV, else Parquet.
Commands that need a model take ``--generator module:function``, a function without
arguments that returns one from a list of prompts to a list of texts.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval.functions import algebra, answers, gates, keys, records
from robusteval.operators import adjudicate, interventions, keysets, lifecycle, metrics
from robusteval.plans import analysis, intervening, requests
from robusteval.session import session, ship_package
from robusteval.sources import files
from robusteval.streaming import resume

SPLITS = list(lifecycle.STAGES)
PAIR = ["dataset", "item_id", "form_id"]


def load(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".jsonl", ".json")):
        return spark.read.option("mode", "FAILFAST").json(path)
    return files.read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def load_rewordings(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path).withColumnRenamed(C.REWORDING_TEXT, "rewording_text")


def generator(name: str):
    """The named function, looked up where it is called: on a worker."""
    module, _, function = name.partition(":")
    return lambda: getattr(importlib.import_module(module), function)()


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def store(df: DataFrame, path: str) -> None:
    if path.endswith((".jsonl", ".json")):
        df.write.mode("overwrite").json(path)
    else:
        files.write_parquet(df, path)


def plan(spark: SparkSession, a: argparse.Namespace) -> None:
    found = keysets.surfaces(load(spark, a.manifest), load_rewordings(spark, a.rewordings), a.split)
    rows, fingerprint = requests.make_plan(a.experiment, found, a.mode, a.protocol, a.items)
    if a.done:
        rows = keysets.pending(rows, load(spark, a.done), C.KEY)
    store(rows.withColumn("config_fingerprint", F.lit(fingerprint)), a.output)


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = records.normalize_source(load(spark, a.input))
    keysets.unique_or_fail(rows, ["dataset", "item_id"], "item")
    store(requests.split_by_hash(rows, {"smoke": a.smoke, "pilot": a.pilot, "confirmatory": a.confirmatory}), a.output)


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    """Scored answers. Rows whose key the output has are left as they are and the others
    added, unless all are to be scored anew."""
    rows, before = load(spark, a.input), None
    if not a.force and resume.folder_exists(spark, a.output):
        before = intervening.kept(load(spark, a.output), "scored")
        rows = keysets.pending(rows, before, C.KEY)
    rows = algebra.score(rows) if a.symbolic else answers.score(rows)
    if a.judgments:
        judged = load(spark, a.judgments).select(*C.KEY, "position", records.parse_reply("reply", ["equivalent", "uncertain"]).alias("p")).select(*C.KEY, "position", "p.*")
        rows = adjudicate.apply_judgments(rows, judged, C.KEY)
    store(rows if before is None else before.unionByName(rows, allowMissingColumns=True), a.output)
    if a.queue:
        files.write_queue(adjudicate.queue(load(spark, a.output)), a.queue)


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    """One round of rewordings that are still wanted, each with its gates."""
    manifest = load(spark, a.manifest).filter(F.col("split") == a.split)
    kinds = F.array(*[F.struct(F.lit(f).alias("form_id"), F.lit(t).alias("transformation_type")) for f, t in C.FORMS[1:]])
    wanted = manifest.select("dataset", "item_id", "split", "original_text", "canonical_answer", F.inline(kinds))
    wanted = wanted.join(load(spark, a.done).select(*PAIR), PAIR, "left_anti") if a.done else wanted
    lifecycle.check_arguments("practical", a.split, a.attempt)
    asked = wanted.withColumn("prompt_text", records.generation_prompt("original_text", "transformation_type")).withColumn("attempt", F.lit(a.attempt))
    made = resume.generate(asked, generator(a.generator), batch=a.batch).withColumn("rewording_text", records.clean_candidate("raw_output"))
    flags = gates.cheap_gates("original_text", "rewording_text")
    made = made.withColumn("normalized_edit_distance", gates.edit_distance("original_text", gates.cleaned("rewording_text")))
    passed = F.col("normalized_edit_distance") >= C.MIN_EDIT_DISTANCE
    for flag in flags.values():
        passed = passed & flag
    store(made.withColumn("gates_passed", F.coalesce(passed, F.lit(False))).drop("prompt_text", "raw_output").withColumnRenamed("rewording_text", C.REWORDING_TEXT), a.output)


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Whether the rewordings of a split are complete and sound."""
    rows = load_rewordings(spark, a.rewordings).filter(F.col("split") == a.split)
    expected = keysets.expected_pairs(load(spark, a.manifest), C.FORM_IDS[1:], a.split)
    failed = ~F.coalesce("gates_passed", F.lit(False)) if "gates_passed" in rows.columns else F.lit(False)
    ratios = adjudicate.word_ratios(rows, records.word_ratio("rewording_text", "original_text"))
    report = adjudicate.rewording_report(expected, rows, ratios, failed).first().asDict()
    examples = keysets.examples(keysets.missing(expected, rows, PAIR), PAIR)
    report |= {"split": a.split, "created_at": files.utc_now(), "missing_examples": [list(r) for r in examples.collect()]}
    files.write_json(spark, a.report, report)
    raise SystemExit(0 if report["passed"] else 2)


def preflight(spark: SparkSession, a: argparse.Namespace) -> None:
    """What stops a stage, printed; none lets it start."""
    reports = [read_json(spark, path) for path in a.validation]
    audited = None if a.audit is None else adjudicate.audit_report(load(spark, a.audit)).first().passed
    revisions = dict(r.partition("=")[::2] for r in a.revision)
    errors = lifecycle.stage_errors(a.stage, {r["split"]: r["passed"] for r in reports}, revisions, a.locked, audited)
    for path in a.input:
        errors += [f"{path}: {e}" for e in exceeded(load(spark, path))]
    for e in errors:
        print(e)
    raise SystemExit(2 if errors else 0)


def judge(spark: SparkSession, a: argparse.Namespace) -> None:
    """Replies of a judge, that sees answer and response only, to what is undecided."""
    done = load(spark, a.done) if a.done else None
    waiting = adjudicate.queue(load(spark, a.scores), done, C.KEY)
    asked = waiting.select(*C.KEY, records.blinded_prompt("canonical_answer", "raw_output").alias("prompt_text"))
    replies = resume.generate(asked, generator(a.generator), batch=a.batch).withColumnRenamed("raw_output", "reply").drop("prompt_text")
    store(replies.withColumn("position", F.lit(a.position)).withColumn("judge_model", F.lit(a.model)).withColumn("created_at", F.lit(files.utc_now())), a.output)


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = load(spark, a.scores[0])
    for path in a.scores[1:]:
        rows = rows.unionByName(load(spark, path), allowMissingColumns=True)
    tables = analysis.analyze(rows, a.resamples)
    files.write_json(spark, a.json, analysis.report(tables))
    if a.markdown:
        files.write_text(spark, a.markdown, files.markdown("Results", tables))
    if a.figure:
        named = F.concat_ws("/", *metrics.BY).alias("run")
        fixed = tables["fixed"].select(named, "mean_output_tokens_per_item", F.col("final_accuracy").alias("accuracy"))
        main = tables["main"].join(tables["costs"], metrics.BY).select(named, "mean_output_tokens_per_item", F.col("mean_accuracy").alias("accuracy"))
        files.write_text(spark, a.figure, files.scatter(fixed.unionByName(main), "mean_output_tokens_per_item", "accuracy", "run"))


def intervention_report(spark: SparkSession, a: argparse.Namespace) -> None:
    """Summaries of intervention runs: the random sample first, then the conditional
    subsets."""
    tables = {name: interventions.summarize(load(spark, path)) for name, path in (("fidelity", a.fidelity), ("lite", a.lite)) if path}
    files.write_json(spark, a.json, {name: df.first().asDict() for name, df in tables.items()})
    if a.markdown:
        note = "Accuracy on the random sample comes first; figures on baseline errors and on disagreements are conditional, and count what probing cost."
        files.write_text(spark, a.markdown, files.markdown("Interventions", tables, note))


def intervene(spark: SparkSession, a: argparse.Namespace) -> None:
    """From logits of trajectories: every position's discrepancy, and each item's
    critical position."""
    scores = interventions.position_scores(load(spark, a.trajectories))
    store(scores, a.positions)
    store(interventions.critical(load(spark, a.positions)), a.output)


def infer(spark: SparkSession, a: argparse.Namespace) -> None:
    """Answers to a plan's requests that the log doesn't have, in rounds: each round is
    appended whole, with its progress beside the log. A run may only go on under the
    plan it began with, and ends between rounds when it is told to stop; a plan that is
    done loads no model."""
    rows = keysets.unique_or_fail(load(spark, a.plan), C.KEY + (["sample_index"] if a.samples else []), "request")
    key = C.KEY + (["sample_index"] if a.samples else [])
    prints = [r.config_fingerprint for r in rows.select("config_fingerprint").distinct().limit(2).collect()]
    if len(prints) != 1:
        raise SystemExit("a plan has one fingerprint")
    beside, stop = f"{a.output}.progress.json", resume.StopFlag().install()
    stored = read_json(spark, beside) if resume.folder_exists(spark, beside) else {}
    resume.check_fingerprint(stored.get("config_fingerprint"), prints[0])
    limits = rows.withColumn("max_tokens", records.max_tokens("mode", "dataset"))
    done = load(spark, a.output).select(*key) if resume.folder_exists(spark, a.output) else spark.createDataFrame([], rows.select(*key).schema)
    rounds = keysets.batched(keysets.pending(limits, done, key), a.round, key, ["max_tokens"])

    def tell() -> dict:
        now = load(spark, a.output) if resume.folder_exists(spark, a.output) else done
        report = resume.progress_report(rows, now, key, prints[0]).first().asDict() | {"stopped": stop(), "updated_at": files.utc_now()}
        files.write_json(spark, beside, report)
        return report

    for r in rounds.select("max_tokens", "batch").distinct().orderBy("max_tokens", "batch").collect():
        if stop():
            break
        part = rounds.filter((F.col("max_tokens") == r.max_tokens) & (F.col("batch") == r.batch)).drop("batch")
        made = resume.generate(part, generator(a.generator), batch=a.batch).withColumn("created_at", F.lit(files.utc_now()))
        # named by what it answers: a round that broke off and is run again replaces itself
        token = keys.object_fingerprint([prints[0], r.max_tokens, r.batch, [list(x) for x in sorted(part.agg(F.count("*"), *[F.min(F.col(k).cast("string")) for k in key]).collect())]])[:24]
        files.append_jsonl(made, a.output, token) if a.output.endswith((".jsonl", ".json")) else made.write.mode("append").parquet(a.output)
        tell()
    raise SystemExit(0 if tell()["complete"] else 3)


def accept(spark: SparkSession, a: argparse.Namespace) -> None:
    """Judgments of rewordings that have none yet: what failed its gates is rejected
    without a judge, the rest is asked, and accepted ones are appended."""
    attempt = [*PAIR, "attempt"]
    made = load_rewordings(spark, a.rewordings).filter(F.col("split") == a.split)
    for path, on in ((a.accepted, PAIR), (a.judgments, attempt)):
        if resume.folder_exists(spark, path):
            made = made.join(load(spark, path).select(*on), on, "left_anti")
    kept = ["split", *attempt]
    failed = made.filter(~F.coalesce("gates_passed", F.lit(False))).select(*kept, F.lit(False).alias("accepted"), F.lit("automatic_gate_failed").alias("judge_status"), F.lit(None).cast("string").alias("reply"))
    asked = made.filter(F.coalesce("gates_passed", F.lit(False))).withColumn("prompt_text", records.judge_prompt("original_text", "rewording_text"))
    four = ["equivalent", "uncertain", "target_preserved", "no_added_hint"]
    replied = resume.generate(asked, generator(a.generator), batch=a.batch).withColumnRenamed("raw_output", "reply").drop("prompt_text")
    replied = replied.withColumn("accepted", records.accepted(records.parse_reply("reply", four))).withColumn("judge_model", F.lit(a.model))
    replied = intervening.kept(replied, "replies")  # asked once, used twice
    status = F.when(F.col("accepted"), "accepted").otherwise("rejected_or_uncertain")
    judged = replied.select(*kept, "accepted", status.alias("judge_status"), "reply")
    append(failed.unionByName(judged).withColumn("judge_model", F.lit(a.model)).withColumn("created_at", F.lit(files.utc_now())), a.judgments)
    good = replied.filter("accepted").drop("accepted", "reply").withColumn("judge_status", F.lit("accepted")).withColumn("accepted_at", F.lit(files.utc_now()))
    append(good.withColumnRenamed("rewording_text", C.REWORDING_TEXT), a.accepted)


def append(df: DataFrame, path: str) -> None:
    if path.endswith((".jsonl", ".json")):
        files.append_jsonl(df, path)
    else:
        df.write.mode("append").parquet(path)


def run_interventions(spark: SparkSession, a: argparse.Namespace) -> None:
    """The whole intervention run of items that the output doesn't have yet."""
    paths, surfaces = load(spark, a.trajectories), load(spark, a.surfaces)
    if resume.folder_exists(spark, a.output):
        done = load(spark, a.output).select("item")
        paths, surfaces = (x.join(done, "item", "left_anti") for x in (paths, surfaces))
    if not paths.isEmpty():
        append(intervening.run_items(paths, surfaces, generator(a.generator), a.candidates, a.samples), a.output)


def stage_assets(spark: SparkSession, a: argparse.Namespace) -> None:
    """The artifacts of a group with the revisions they are pinned to."""
    config = {use: [tuple(x) for x in listed] for use, listed in files.read_yaml(a.config)["artifacts"].items()}
    resolved = read_json(spark, a.resolved) if a.resolved else {}
    found = [{"kind": kind, "id": name, "revision": lifecycle.pinned(revision, resolved, name)} for kind, name, revision in lifecycle.artifacts(a.group, config)]
    files.write_json(spark, a.output, found)


def environment(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_json(spark, a.output, files.environment(spark, a.label))


def audit_sheet(spark: SparkSession, a: argparse.Namespace) -> None:
    """A blinded sheet of sampled pairs for an auditor; an old one is kept unless forced."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(a.output)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    lifecycle.refuse_existing(there, a.force, a.output)
    pairs = load_rewordings(spark, a.rewordings).filter("split = 'confirmatory'")
    requests.audit_sheet(pairs).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(a.output)


def exceeded(rows: DataFrame) -> list[str]:
    """Gates that results fail."""
    bad = adjudicate.result_gates(rows, C.KEY, ["mode", "method"]).filter("failed").collect()
    return [f"{r.mode}/{r.method}: {r.gate} {r.value:.4g} exceeds {r.allowed:.4g}" for r in bad]


def result_gates(spark: SparkSession, a: argparse.Namespace) -> None:
    bad = exceeded(load(spark, a.input))
    print("\n".join(bad))
    raise SystemExit(2 if bad else 0)


def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    row = adjudicate.audit_report(load(spark, a.input)).first()
    print(row.asDict())
    raise SystemExit(0 if row.passed else 2)


def capacity(spark: SparkSession, a: argparse.Namespace) -> None:
    metrics.throughput(load(spark, a.input), a.responses, ["mode", "method"], a.tokens_per_second).show()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="robusteval", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)

    def add(run, *options: tuple, name: str | None = None) -> None:
        p = sub.add_parser(name or run.__name__)
        for flag, kwargs in options:
            p.add_argument(flag, **kwargs)
        p.set_defaults(run=run)

    need = {"required": True}
    number = lambda n: {"type": int, "default": n}
    many = {"action": "append", "default": []}
    split = ("--split", {"choices": SPLITS, "default": "confirmatory"})
    rewordings, manifest = ("--rewordings", need), ("--manifest", need)
    add(prepare, ("--input", need), ("--output", need), ("--smoke", number(5)), ("--pilot", number(40)), ("--confirmatory", number(200)))
    add(generate, manifest, split, ("--generator", need), ("--attempt", number(1)), ("--done", {}), ("--batch", number(C.BATCH_SIZE)), ("--output", need))
    add(validate, manifest, rewordings, split, ("--report", need))
    add(preflight, ("--stage", {"choices": SPLITS, "required": True}), ("--validation", many), ("--revision", many), ("--audit", {}), ("--locked", {"action": "store_true"}), ("--input", many))
    add(plan, ("--experiment", {"choices": ["main", "scop", "external"], "required": True}), manifest, rewordings, split, ("--mode", {"default": "non_thinking"}), ("--protocol", {"default": "practical"}), ("--items", number(200)), ("--done", {}), ("--output", need))
    add(score, ("--input", need), ("--output", need), ("--judgments", {}), ("--queue", {}), ("--symbolic", {"action": "store_true"}), ("--force", {"action": "store_true"}))
    add(judge, ("--scores", need), ("--generator", need), ("--model", {"default": ""}), ("--done", {}), ("--position", number(0)), ("--batch", number(C.BATCH_SIZE)), ("--output", need))
    add(analyze, ("--scores", {"action": "append", "required": True}), ("--json", {"default": "results.json"}), ("--markdown", {}), ("--figure", {}), ("--resamples", number(C.BOOTSTRAP_RESAMPLES)))
    add(result_gates, ("--input", need), name="gates")
    add(audit_sheet, rewordings, ("--output", need), ("--force", {"action": "store_true"}), name="audit-sheet")
    add(audit, ("--input", need))
    add(infer, ("--plan", need), ("--generator", need), ("--samples", {"action": "store_true"}), ("--batch", number(C.BATCH_SIZE)), ("--round", number(100_000)), ("--output", need))
    add(accept, rewordings, split, ("--generator", need), ("--model", {"default": ""}), ("--batch", number(C.BATCH_SIZE)), ("--judgments", need), ("--accepted", need))
    add(run_interventions, ("--trajectories", need), ("--surfaces", need), ("--generator", need), ("--candidates", number(11)), ("--samples", number(0)), ("--output", need), name="run-interventions")
    add(intervene, ("--trajectories", need), ("--positions", need), ("--output", need))
    add(intervention_report, ("--fidelity", {}), ("--lite", {}), ("--json", need), ("--markdown", {}), name="intervention-report")
    add(stage_assets, ("--group", need), ("--config", need), ("--resolved", {}), ("--output", need), name="stage")
    add(environment, ("--label", {"default": ""}), ("--output", need))
    add(capacity, ("--input", need), ("--responses", {"type": int, "required": True}), ("--tokens-per-second", {"type": float}))
    return out


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session()
    ship_package(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
