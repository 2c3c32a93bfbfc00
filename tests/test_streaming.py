import json

import pytest

from robusteval import cli
from robusteval import constants as C
from robusteval.functions import keys
from robusteval.sources import files
from robusteval.streaming import resume

SCHEMA = "k string, v int"


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).json(str(path))


def test_runs_append_each_key_once(spark, tmp_path):
    source, log = tmp_path / "in", str(tmp_path / "log")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], SCHEMA).coalesce(1).write.json(str(source))
    seen = []
    assert resume.append_new(stream(spark, source), ["k"], log, str(tmp_path / "c1"), progress=seen.append) == 1
    assert seen[0]["batches"] == 1
    spark.createDataFrame([("b", 4), ("c", 5)], SCHEMA).coalesce(1).write.mode("append").json(str(source))
    resume.append_new(stream(spark, source), ["k"], log, str(tmp_path / "c1"))
    resume.append_new(stream(spark, source), ["k"], log, str(tmp_path / "c2"))
    assert sorted(r.k for r in spark.read.parquet(log).collect()) == ["a", "b", "c"]


def test_a_batch_reads_its_own_rows_only_and_may_be_replayed(spark, tmp_path):
    """After the first batch nothing of the log is read: it may even be gone. A run that
    stops leaves its due batch to the next one."""
    source, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "c")
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(source))
    own = lambda: sorted((r.k, r.v) for r in resume.read_log(spark, log, schema).collect())
    schema = spark.createDataFrame([], SCHEMA).schema
    add([("a", 1), ("b", 1)])
    resume.append_new(stream(spark, source), ["k"], log, check)
    add([("a", 2), ("c", 2)])
    assert resume.append_new(stream(spark, source), ["k"], log, check, should_stop=lambda: True) == 0
    assert own() == [("a", 1), ("b", 1)]
    (tmp_path / "log").rename(tmp_path / "away")
    assert resume.append_new(stream(spark, source), ["k"], log, check) == 1
    assert own() == [("c", 2)]
    (tmp_path / "log").rename(tmp_path / "later")
    (tmp_path / "away").rename(tmp_path / "log")
    # a replayed first batch of a new checkpoint finds its own folder and replaces it
    resume.append_new(stream(spark, source), ["k"], log, str(tmp_path / "d"))
    once = own()
    import shutil

    shutil.rmtree(tmp_path / "d" / "commits")
    shutil.rmtree(tmp_path / "d" / "state")
    resume.append_new(stream(spark, source), ["k"], log, str(tmp_path / "d"))
    assert own() == once == [("a", 1), ("b", 1), ("c", 2)]


def test_the_listener_tells_what_each_batch_brought(spark, tmp_path):
    source, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "c")
    told = []
    for rows in ([("a", 1), ("a", 2), ("b", 1)], [("b", 2), ("c", 1)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(source))
        resume.append_new(stream(spark, source), ["k"], log, check, watch=told.append)
    assert [(t["batch"], t["arrived"], t["logged"]) for t in told if t["arrived"]] == [(0, 3, 0), (1, 2, 0)]
    resume.append_new(stream(spark, source), ["k"], log, str(tmp_path / "d"), watch=told.append)
    assert (told[-1]["arrived"], told[-1]["logged"]) == (5, 3) and all(t["seconds"] >= 0 for t in told)


def test_fingerprints_and_stop():
    resume.check_fingerprint(None, "a")
    resume.check_fingerprint("a", "a")
    with pytest.raises(RuntimeError):
        resume.check_fingerprint("a", "b")
    flag = resume.StopFlag()
    assert not flag()
    flag.set()
    assert flag()


def test_retries(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    tried = spark.createDataFrame([("a", 1, True), ("b", 1, False), ("b", 2, False), ("c", 4, False)], "k string, attempt int, accepted boolean")
    assert {r.k: r.attempt for r in resume.retry_pending(expected, tried, ["k"], 4).collect()} == {"b": 3, "d": 1}


def test_generation_builds_its_model_on_the_first_prompt(spark):
    plan = spark.createDataFrame([("a", "p1"), ("b", "p2")], "k string, prompt_text string")

    def make():
        return lambda texts: [t.upper() for t in texts]

    assert {r.k: r.raw_output for r in resume.generate(plan, make).collect()} == {"a": "P1", "b": "P2"}

    def broken():
        raise RuntimeError("must not load")

    assert resume.generate(plan.filter("k = 'z'"), broken).count() == 0


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "x")
    assert files.read_jsonl(spark, path, SCHEMA).count() == 0
    assert files.append_jsonl(spark.createDataFrame([("a", 1)], SCHEMA), path) == 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "bad.jsonl").write_text('{"k": "a", "v": 1}\n{bad}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad"), SCHEMA).collect()
    assert files.first_bad_line(spark, str(tmp_path / "bad")).endswith("bad.jsonl:2")


def test_lines_are_numbered_without_reading_a_file_whole(spark, tmp_path):
    lines = ['{"k": "a%d", "v": %d}' % (n, n) for n in range(5000)]
    lines[7], lines[4000] = "", "  "
    (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.jsonl").write_text('{"k": "z", "v": -1}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_numbered_jsonl(spark, str(tmp_path), SCHEMA)
        assert rows.rdd.getNumPartitions() > 10
        got = {r.v: (r.file.rsplit("/", 1)[1], r.number) for r in rows.collect()}
        assert got == {n: ("one.jsonl", n + 1) for n in range(5000) if n not in (7, 4000)} | {-1: ("two.jsonl", 1)}
        lines[3000] = "[1]"
        (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n")
        with pytest.raises(Exception, match="one.jsonl:3001 is no JSON object"):
            files.read_numbered_jsonl(spark, str(tmp_path), SCHEMA).collect()
        assert files.first_bad_line(spark, str(tmp_path)).endswith("one.jsonl:3001")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_an_append_that_broke_off_is_finished_once(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), spark.range(100).repartition(5)
    moved, real = [], files.write_json

    def breaks(spark, place, value):
        if "_appended" in place and not moved:
            moved.append(place)
            raise OSError("lost")
        real(spark, place, value)

    monkeypatch.setattr(files, "write_json", breaks)
    with pytest.raises(OSError):
        files.append_jsonl(rows, path, "t1")
    assert files.append_jsonl(rows, path, "t1") == 100 == files.append_jsonl(rows, path, "t1")
    assert sorted(r.id for r in files.read_jsonl(spark, path, "id long").collect()) == list(range(100))
    assert files.append_jsonl(rows.limit(0), path, "none") == 0
    assert not list((tmp_path / "t" / "_pending").iterdir())


def test_small_files(spark, tmp_path):
    files.write_json(spark, str(tmp_path / "r.json"), {"b": 1, "a": "é"})
    assert (tmp_path / "r.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    (tmp_path / "c.yaml").write_text("a: 1\n")
    assert files.read_yaml(str(tmp_path / "c.yaml")) == {"a": 1}
    (tmp_path / "d.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        files.read_yaml(str(tmp_path / "d.yaml"))
    (tmp_path / "s.csv").write_text("﻿audit_id,notes\na1,\"x, y\"\n", encoding="utf-8")
    assert files.read_csv(spark, str(tmp_path / "s.csv")).first().asDict() == {"audit_id": "a1", "notes": "x, y"}
    files.write_json(spark, str(tmp_path / "r.json"), [1])
    assert (tmp_path / "r.json").read_text() == "[\n  1\n]\n" and not list(tmp_path.glob("*.part"))
    table = spark.createDataFrame([("b", 0.5), ("a|c", None)], "name string, x double")
    assert files.markdown("T", {"g": table}, "n") == "# T\n\nn\n\n## g\n\n| name | x |\n| --- | ---: |\n| a\\|c |  |\n| b | 0.5 |\n"
    figure = files.scatter(spark.createDataFrame([(1.0, 0.5, "a<b"), (2.0, 0.7, "c"), (None, 1.0, "d")], "t double, y double, n string"), "t", "y", "n")
    assert figure.count("<circle") == 2 and "a&lt;b" in figure
    record = files.environment(spark, "x")
    assert record["spark"] == spark.version and any(p.startswith("numpy==") for p in record["packages"])


def test_command_line_scores_and_gates(spark, sf_dir, tmp_path, monkeypatch):
    from robusteval.sources import fixtures

    monkeypatch.setattr(cli, "session", lambda: spark)
    raw, out = str(tmp_path / "raw"), str(tmp_path / "scored")
    fixtures.completions(spark, sf_dir).limit(50).select("dataset", "canonical_answer", "raw_output").write.parquet(raw)
    cli.main(["score", "--input", raw, "--output", out])
    assert spark.read.parquet(out).count() == 50
    rows = str(tmp_path / "rows")
    fixtures.scored(spark, sf_dir).write.parquet(rows)
    cli.main(["analyze", "--scores", rows, "--json", str(tmp_path / "r.json"), "--markdown", str(tmp_path / "r.md"), "--resamples", "10"])
    assert "math_500/thinking/main" in json.loads((tmp_path / "r.json").read_text())
    with pytest.raises(SystemExit) as end:
        cli.main(["gates", "--input", rows])
    assert end.value.code in (0, 2)
    cli.main(["analyze", "--scores", rows, "--json", str(tmp_path / "r.json"), "--figure", str(tmp_path / "f.svg"), "--resamples", "5"])
    assert "<circle" in (tmp_path / "f.svg").read_text()
    cli.main(["capacity", "--input", rows, "--responses", "15"])


def echo():
    """A stand-in for a model: rewords by adding words, and judges all equal."""
    def reply(text):
        if "REFERENCE ANSWER" in text:
            return '{"equivalent": true, "uncertain": false, "reason": "r"}'
        return "Put in quite other words than it was put before: " + text.rstrip().rsplit("\n", 1)[1]

    return lambda prompts: [reply(p) for p in prompts]


def ends(command):
    with pytest.raises(SystemExit) as end:
        cli.main(command)
    return end.value.code


def test_command_line_from_manifest_to_preflight(spark, sf_dir, tmp_path, monkeypatch):
    from robusteval.sources import fixtures

    monkeypatch.setattr(cli, "session", lambda: spark)
    at = lambda name: str(tmp_path / name)
    own = f"{__name__}:echo"
    fixtures.manifest(spark, sf_dir).filter("split = 'smoke'").limit(6).write.parquet(at("manifest"))
    cli.main(["generate", "--manifest", at("manifest"), "--split", "smoke", "--generator", own, "--output", at("made")])
    made = spark.read.parquet(at("made"))
    assert made.count() == 42 and C.REWORDING_TEXT in made.columns and made.filter("gates_passed").count() > 0
    cli.main(["generate", "--manifest", at("manifest"), "--split", "smoke", "--generator", own, "--done", at("made"), "--output", at("more")])
    assert spark.read.parquet(at("more")).count() == 0
    made.withColumn("gates_passed", made.gates_passed | True).write.parquet(at("whole"))
    assert ends(["validate", "--manifest", at("manifest"), "--rewordings", at("whole"), "--split", "smoke", "--report", at("v.json")]) == 0
    made.limit(40).write.parquet(at("part"))
    assert ends(["validate", "--manifest", at("manifest"), "--rewordings", at("part"), "--split", "smoke", "--report", at("w.json")]) == 2
    report = json.loads((tmp_path / "w.json").read_text())
    assert report["missing_count"] == 2 and len(report["missing_examples"]) == 2
    assert ends(["preflight", "--stage", "smoke", "--validation", at("v.json"), "--locked", "--revision", "model=" + "a" * 40]) == 0
    assert ends(["preflight", "--stage", "smoke", "--validation", at("w.json"), "--locked", "--revision", "model=main"]) == 2
    assert ends(["preflight", "--stage", "confirmatory", "--locked"]) == 2


def test_command_line_judges_audits_and_reports(spark, sf_dir, tmp_path, monkeypatch):
    from robusteval.sources import fixtures

    monkeypatch.setattr(cli, "session", lambda: spark)
    at = lambda name: str(tmp_path / name)
    raw = fixtures.completions(spark, sf_dir).limit(40)
    keyed = raw.selectExpr("dataset", "concat(order_id, '-', line_no, '-', part_id) item_id", "'original' form_id", "'thinking' mode", "1 seed", "'main' method", "canonical_answer", "raw_output")
    keyed.write.parquet(at("raw"))
    cli.main(["score", "--input", at("raw"), "--output", at("scores"), "--queue", at("queue")])
    waiting = files.read_csv(spark, at("queue"))
    assert waiting.columns == C.QUEUE
    cli.main(["judge", "--scores", at("scores"), "--generator", f"{__name__}:echo", "--model", "m", "--output", at("replies")])
    assert spark.read.parquet(at("replies")).count() == waiting.count() > 0
    cli.main(["judge", "--scores", at("scores"), "--generator", f"{__name__}:echo", "--done", at("replies"), "--output", at("none")])
    assert spark.read.parquet(at("none")).count() == 0
    cli.main(["score", "--input", at("raw"), "--judgments", at("replies"), "--output", at("decided")])
    assert spark.read.parquet(at("decided")).filter("correctness is null").count() == 0
    fixtures.rewordings(spark, sf_dir).filter("split = 'confirmatory'").limit(300).write.parquet(at("pairs"))
    cli.main(["audit-sheet", "--rewordings", at("pairs"), "--output", at("sheet")])
    sheet = files.read_csv(spark, at("sheet"))
    assert sheet.columns == C.AUDIT_SHEET and [r.audit_id for r in sheet.orderBy("audit_id").collect()] == [f"audit-{k:04d}" for k in range(1, 81)]
    with pytest.raises(FileExistsError):
        cli.main(["audit-sheet", "--rewordings", at("pairs"), "--output", at("sheet")])
    (tmp_path / "c.yaml").write_text("artifacts:\n  primary: [[model, big, " + "b" * 40 + "]]\n  embedding: [[model, small, null]]\n")
    (tmp_path / "pins.json").write_text(json.dumps({"small": "c" * 40}))
    cli.main(["stage", "--group", "all", "--config", at("c.yaml"), "--resolved", at("pins.json"), "--output", at("staged.json")])
    assert [x["revision"][0] for x in json.loads((tmp_path / "staged.json").read_text())] == ["b", "c"]
    cli.main(["environment", "--label", "l", "--output", at("env.json")])
    assert json.loads((tmp_path / "env.json").read_text())["label"] == "l"
    fixtures.trajectories(spark, sf_dir).write.parquet(at("tr"))
    cli.main(["intervene", "--trajectories", at("tr"), "--positions", at("positions"), "--output", at("critical")])
    assert spark.read.parquet(at("critical")).count() > 0
    runs = spark.createDataFrame([("a", True, False, False, True, 5, 6, 0.1, 0.2), ("b", False, True, True, False, 7, 8, 0.3, 0.4)], "item_id string, correctness boolean, initial_correctness boolean, sc_correctness boolean, sc_disagrees boolean, ppcv_output_tokens int, sc_output_tokens int, probe_seconds double, ppcv_seconds double")
    runs.write.parquet(at("runs"))
    cli.main(["intervention-report", "--lite", at("runs"), "--json", at("i.json"), "--markdown", at("i.md")])
    assert json.loads((tmp_path / "i.json").read_text())["lite"]["baseline_error_n"] == 1 and "## lite" in (tmp_path / "i.md").read_text()


def model():
    """A stand-in that answers requests, rollouts and samples."""
    return lambda prompts: [f"the answer is {len(p) % 3}" for p in prompts]


def test_command_line_infers_in_rounds_and_resumes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    at = lambda name: str(tmp_path / name)
    rows = [("math_500", f"i{k}", "original", ("thinking", "non_thinking")[k % 2], 1, "main", "p" * k, "f") for k in range(30)]
    kinds = "dataset string, item_id string, form_id string, mode string, seed long, method string, prompt_text string, config_fingerprint string"
    spark.createDataFrame(rows, kinds).write.parquet(at("plan"))

    def run(output, *more):
        with pytest.raises(SystemExit) as end:
            cli.main(["infer", "--plan", at("plan"), "--generator", "tests.test_streaming:model", "--output", output, *more])
        return end.value.code

    for output in (at("log.jsonl"), at("log")):
        asked = []
        monkeypatch.setattr(resume.StopFlag, "__call__", lambda self: len(asked) > 2 or asked.append(1))  # noqa: B023
        assert run(output, "--round", "4") == 3
        monkeypatch.undo()
        monkeypatch.setattr(cli, "session", lambda: spark)
        some = cli.load(spark, output).count()
        assert 0 < some < 30
        assert run(output, "--round", "7") == 0 and run(output) == 0
        got = cli.load(spark, output).collect()
        assert len(got) == 30 and {r.item_id for r in got} == {f"i{k}" for k in range(30)}
        report = json.loads((tmp_path / (output.rsplit("/", 1)[1] + ".progress.json")).read_text())
        assert report["complete"] and report["config_fingerprint"] == "f" and report["completed_records"] == 30
    spark.createDataFrame([(*r[:-1], "g") for r in rows], kinds).write.mode("overwrite").parquet(at("plan"))
    with pytest.raises(RuntimeError):
        cli.main(["infer", "--plan", at("plan"), "--generator", "tests.test_streaming:model", "--output", at("log")])


def judge_stub():
    def reply(text):
        good = "fine" in text
        return json.dumps({"equivalent": good, "uncertain": False, "target_preserved": True, "no_added_hint": True})

    return lambda prompts: [reply(p) for p in prompts]


def test_command_line_accepts_rewordings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    at = lambda name: str(tmp_path / name)
    rows = [("d", "a", "voice", "pilot", 1, "o", "fine words", True), ("d", "b", "voice", "pilot", 1, "o", "bad words", True), ("d", "c", "voice", "pilot", 1, "o", "fine but gated", False), ("d", "e", "voice", "smoke", 1, "o", "fine", True)]
    kinds = f"dataset string, item_id string, form_id string, split string, attempt int, original_text string, {C.REWORDING_TEXT} string, gates_passed boolean"
    spark.createDataFrame(rows, kinds).write.parquet(at("made"))
    run = ["accept", "--rewordings", at("made"), "--split", "pilot", "--generator", "tests.test_streaming:judge_stub", "--judgments", at("judged.jsonl"), "--accepted", at("accepted")]
    cli.main(run)
    cli.main(run)
    judged = {r.item_id: r.judge_status for r in cli.load(spark, at("judged.jsonl")).collect()}
    assert judged == {"a": "accepted", "b": "rejected_or_uncertain", "c": "automatic_gate_failed"}
    assert cli.load(spark, at("judged.jsonl")).count() == 3
    assert [(r.item_id, r[C.REWORDING_TEXT]) for r in cli.load(spark, at("accepted")).collect()] == [("a", "fine words")]


def test_command_line_runs_interventions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    at = lambda name: str(tmp_path / name)
    logits = lambda k, f: [float((3 * k + 5 * f + 7 * j) % 11) for j in range(12)]
    spark.createDataFrame([(i, p, f, (p + f) % 12 if f == 0 else p % 12, logits(p, f)) for i in ("x", "y") for p in range(4) for f in range(2)], "item string, position long, form_no int, actual int, logits array<double>").write.parquet(at("paths"))
    spark.createDataFrame([(i, f, ("original", "voice")[f], f"{i} {f}", "gsm_symbolic", "1", [1.0, float(f)]) for i in ("x", "y") for f in range(2)], "item string, form_no int, form_id string, prompt string, dataset string, canonical_answer string, v array<double>").write.parquet(at("forms"))
    run = ["run-interventions", "--trajectories", at("paths"), "--surfaces", at("forms"), "--generator", "tests.test_streaming:model", "--candidates", "3", "--samples", "4", "--output", at("out")]
    cli.main(run)
    cli.main(run)
    got = spark.read.parquet(at("out")).collect()
    assert sorted(r.item for r in got) == ["x", "y"]
    assert all(r.n_rollouts == 6 and r.initial_tokens == 4 and r.ppcv_output_tokens == 4 + 6 * 4 and r.sc_output_tokens == 16 for r in got)
    assert all(r.selected_answer in "012" and r.consistency > 0 for r in got)
    short = spark.read.parquet(at("paths")).filter("position = 0")
    from robusteval.plans import intervening

    with pytest.raises(Exception, match="too short a trajectory"):
        intervening.run_items(short, spark.read.parquet(at("forms")), model).collect()


def test_stored_trajectories_of_one_token_have_rows(spark, tmp_path):
    from robusteval.catalog import QUERIES

    vectors = [(i, i % 2, [float((3 * i + 7 * j) % 11) for j in range(64)]) for i in (0, 1, 2, 3, 101)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.item: r for r in QUERIES["pp_run_item"](spark, str(tmp_path)).collect()}
    assert {k: r.initial_tokens for k, r in got.items()} == {"t0-0": 2, "t1-0": 2, "t1-1": 1}
    assert got["t1-1"].critical_position == 0 and got["t1-1"].n_rollouts == 33


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert keys.object_fingerprint({})


def test_small_batches_leave_a_session_its_own_choice(spark):
    from robusteval.session import small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "500")
        small_batches(spark)
        assert spark.conf.get(name) == "500"
        spark.conf.unset(name)
        if spark.conf.get(name) == "10000":
            small_batches(spark, 1234)
            assert spark.conf.get(name) == "1234"
    finally:
        spark.conf.set(name, before)
