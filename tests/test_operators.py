"""Hand-computed tables: the expected values and the edges of each operator."""

import math
import random
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval.operators import adjudicate, budget, interventions, keysets, lifecycle, metrics, order, resample, stats
from robusteval.plans import analysis, requests

ROWS = "dataset string, mode string, method string, item_id string, form_id string, seed int, sample_index int, parsed_answer string, correctness boolean, normalized_log_probability double, input_tokens long, output_tokens long, gpu_seconds double, latency_seconds double, raw_exact_match boolean, normalized_match boolean, canonical_match boolean, judge_required boolean, answer_format_ok boolean, truncated boolean, finish_reason string, raw_output string"


def row(item, form, right, answer="1", method="main", mode="thinking", seed=0, index=0, lp=0.0, tokens=20, finish="stop", raw="x"):
    return ("d", mode, method, item, form, seed, index, answer, right, lp, 10, tokens, 0.5, 0.5, right, right, right, False, True, False, finish, raw)


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_main_metrics_of_two_items(spark):
    rows = [row(i, f, r, str(r), seed=k) for i, f, verdicts in (("a", "original", "TTT"), ("a", "lexical", "TTF"), ("b", "original", "TFF"), ("b", "lexical", "TTT")) for k, r in enumerate(v == "T" for v in verdicts)]
    m = metrics.main_metrics(table(spark, rows)).first()
    assert (m.robust_accuracy, m.correctness_flip_rate, m.answer_flip_rate) == (0.5, 0.5, 0.5)
    assert m.mean_accuracy == pytest.approx(9 / 12) and m.original_accuracy == pytest.approx(4 / 6)
    assert 0 <= m.pi_form <= 1
    run = (0 + 2 / 9 + 2 / 9 + 0) / 4
    form = ((1 / 6) ** 2 + (1 / 3) ** 2) / 2
    item = (5 / 6 - 4 / 6) ** 2 / 4
    assert (m.v_run, m.v_form, m.v_item) == pytest.approx((run, form, item))
    assert m.pi_form == pytest.approx(form / (run + form + item))


def brute_majority(rows):
    """rows: (answer, correct, lp)."""
    given = [a for a, _, _ in rows if a is not None]
    if not given:
        return None, 0.0, None
    counts = Counter(given)
    top = max(counts.values())
    tied = [a for a in counts if counts[a] == top]
    lp = {a: round(sum(p or 0.0 for b, _, p in rows if b == a), 9) for a in tied}
    best = min(a for a in tied if lp[a] == max(lp.values()))
    decided = [c for a, c, _ in rows if a == best and c is not None]
    return best, top / len(rows), (sum(decided) * 2 >= len(decided)) if decided else None


def test_votes_against_brute_force(spark):
    rng = random.Random(1)
    groups = {f"i{k}": [(rng.choice([None, "1", "2", "10", "é"]), rng.choice([None, True, False]), rng.choice([None, -0.5, -1.0, -1.5])) for _ in range(rng.randint(1, 8))] for k in range(200)}
    groups["none"] = [(None, True, 0.0)] * 3
    groups["logprob"] = [("2", True, -1.0), ("1", True, -2.0)]
    groups["text"] = [("2", True, -1.0), ("10", False, -1.0)]
    groups["even"] = [("1", True, 0.0), ("1", False, 0.0)]
    df = table(spark, [row(i, "original", c, a, lp=p) for i, rows in groups.items() for a, c, p in rows])
    got = {r.item_id: (r.majority_answer, r.confidence, r.majority_correct) for r in metrics.majority(df, ["item_id"]).collect()}
    assert got == {i: brute_majority(rows) for i, rows in groups.items()}
    assert got["even"][2] is True and got["logprob"][0] == "2" and got["text"][0] == "10"


def test_robust_needs_every_form_of_the_group(spark):
    rows = [row("a", "original", True), row("a", "lexical", True), row("b", "original", True), row("c", "original", True), row("c", "lexical", None)]
    got = {r.item_id: r for r in metrics.item_robustness(metrics.item_forms(table(spark, rows))).collect()}
    assert [got[i].robust for i in "abc"] == [True, False, False]
    assert got["c"].worst_form_solve_rate == 1.0


def test_fixed_budget_of_one_item(spark):
    rows = [row("a", "original", k < 6, "1" if k < 6 else "2", method="sc_8", mode="non_thinking", index=k) for k in range(8)]
    m = metrics.fixed_budget(table(spark, rows)).first()
    assert m.final_accuracy == 1.0 and m.mean_output_tokens_per_item == 160
    assert m.auroc_disagreement is None
    assert m.brier_score == pytest.approx(0.0625) and m.ece_fixed == pytest.approx(0.25)
    e = metrics.entropy(table(spark, rows), ["item_id"]).first().entropy
    assert e == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))


def cal(spark, rows):
    return spark.createDataFrame([("d", "m", "x", f"i{k:04d}", c, y, e) for k, (c, y, e) in enumerate(rows)], "dataset string, mode string, method string, item_id string, c double, y double, entropy double")


def test_calibration_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0.0, 0.1, 0.3, 0.25, 0.7, 1.0, rng.random()]), float(rng.random() < 0.5), rng.choice([0.0, 0.5, 1.0])) for _ in range(57)]
    df = cal(spark, rows)
    edges = [i * (1.0 / 10) for i in range(10)] + [1.0]
    fixed = 0.0
    for b in range(10):
        inside = [(c, y) for c, y, _ in rows if edges[b] <= c and (c < edges[b + 1] or b == 9)]
        if inside:
            fixed += len(inside) / len(rows) * abs(sum(c for c, _ in inside) / len(inside) - sum(y for _, y in inside) / len(inside))
    assert metrics.ece_fixed(df).first().ece_fixed == pytest.approx(fixed)
    order = sorted(rows, key=lambda r: r[0])
    adaptive, at = 0.0, 0
    for b in range(10):
        size = 57 // 10 + (b < 57 % 10)
        chunk = order[at : at + size]
        at += size
        adaptive += size / 57 * abs(sum(c for c, _, _ in chunk) / size - sum(y for _, y, _ in chunk) / size)
    assert metrics.ece_adaptive(df).first().ece_adaptive == pytest.approx(adaptive)
    wrong = [1 - c for c, y, _ in rows if y == 0]
    right = [1 - c for c, y, _ in rows if y == 1]
    area = sum((a > b) + 0.5 * (a == b) for a in wrong for b in right) / (len(wrong) * len(right))
    assert metrics.auroc(df, metrics.BY, 1 - F.col("c"), "a").first().a == pytest.approx(area)
    assert metrics.ece_adaptive(cal(spark, [(0.5, 1.0, 0.0)])).first().ece_adaptive == pytest.approx(0.5)


def test_costs_count_failures_and_blanks(spark):
    rows = [row("a", "original", True), row("a", "lexical", False, finish=None), row("b", "original", None, raw=" "), row("b", "lexical", True, finish="length")]
    m = metrics.costs(table(spark, rows)).first()
    assert m.generation_failure_rate == 0.5 and m.n_items == 2 and m.mean_output_tokens_per_item == 40
    assert m.symbolic_pre_judge_accuracy == pytest.approx(2 / 3) and m.raw_exact_accuracy == 0.5
    assert m.peak_gpu_memory_gib is None


def test_throughput(spark):
    assert metrics.throughput(table(spark, [row("a", "original", True)]), 15, ["mode"]).first().n_max == math.floor(0.7 * 28800 * 40 / 300)


def test_pareto(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.5), ("c", 2.0, 0.7), ("d", 3.0, 0.6)], "n string, tokens double, accuracy double")
    assert {r.n: r.on_frontier for r in metrics.pareto(df).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_token_matching_passes_over_what_does_not_fit(spark):
    def sample(method, costs):
        return [row("a", "original", True, method=method, mode="non_thinking", index=k, tokens=t) for k, t in enumerate(costs)]

    rows = sample("sc_8", [10]) + sample("scop_2x4", [5, 4, 9, 1]) + sample("scop_4x2", [11, 1])
    got = {}
    for r in budget.token_match(table(spark, rows)).collect():
        got.setdefault(r.method, []).append(r.output_tokens)
    assert got == {"sc_8": [10], "scop_2x4": [5, 4, 1], "scop_4x2": [11]}
    with pytest.raises(Exception, match="reference budget"):
        budget.token_match(table(spark, [*rows, row("b", "original", True, method="scop_2x4", mode="non_thinking")])).collect()


def test_exact_binomial(spark):
    pairs = [(3, 9), (5, 5), (0, 4), (0, 0), (120, 90), (1, 8), (40, 3)]
    df = spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate(pairs)], "i int, b long, c long")
    got = [r.p for r in df.select("i", stats.binomial_p(F.col("b"), F.col("c")).alias("p")).orderBy("i").collect()]
    want = [min(1.0, 2 * sum(comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0 for b, c in pairs]
    assert got == pytest.approx(want, abs=2e-9)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.03)], "n string, pvalue double")
    got = {r.n: r.holm_adjusted_pvalue for r in stats.holm(df).collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.09, "c": 0.09, "d": 0.09})
    unknown = stats.holm(df.unionByName(spark.createDataFrame([("e", None)], "n string, pvalue double"))).collect()
    assert all(r.holm_adjusted_pvalue is None for r in unknown)


def test_wilson(spark):
    df = spark.createDataFrame([(95, 100), (0, 0), (0, 5), (5, 5)], "s int, n int")
    low, high = stats.wilson(F.col("s"), F.col("n"))
    got = df.select(low.alias("low"), high.alias("high")).collect()
    assert got[0].low == pytest.approx(0.8882, abs=1e-3)
    assert (got[1].low, got[1].high) == (0, 0)
    assert got[2].low == 0 and got[3].high == 1


def test_resampling_is_near_theory(spark):
    rng = random.Random(5)
    xs = [float(rng.random() < 0.3) for _ in range(400)]
    df = spark.createDataFrame([("d", f"i{k}", x) for k, x in enumerate(xs)], "dataset string, item_id string, v double")
    mean, sd = sum(xs) / 400, (sum(xs) / 400 * (1 - sum(xs) / 400) / 400) ** 0.5
    found = resample.mean(df, ["dataset"], "item_id", "v", 2000).first()
    blocks = resample.mean(df.repartition(7), ["dataset"], "item_id", "v", 2000, size=32, unit=2).first()
    for r in (found, blocks):
        assert r.mean_low == pytest.approx(mean - 1.96 * sd, abs=0.012) and r.mean_high == pytest.approx(mean + 1.96 * sd, abs=0.012)
    again = resample.mean(df.repartition(3), ["dataset"], "item_id", "v", 2000, size=32, unit=5, at_once=123)
    assert resample.mean(df.repartition(7), ["dataset"], "item_id", "v", 2000).first() == found
    assert resample.mean(df.limit(0), ["dataset"], "item_id", "v", 10).count() == 0
    assert again.count() == 1


def test_weights_of_blocks_are_multinomial():
    """Blocks of a draw add up to its size, and counts have the multinomial's moments."""
    n, size, draws = 1000, 64, 3000
    blocks = [resample.weights(n, b, min(size, n - b * size), 7, 0, draws, size) for b in range(16)]
    whole = np.concatenate(blocks, axis=1)
    assert whole.shape == (draws, n) and (whole.sum(axis=1) == n).all()
    assert abs(whole.mean() - 1) < 1e-12 and abs(whole.var() - (1 - 1 / n)) < 0.01
    inside, apart = np.corrcoef(whole[:, 3], whole[:, 5])[0, 1], np.corrcoef(blocks[0].sum(1), blocks[9].sum(1))[0, 1]
    p = size / n
    assert abs(inside) < 0.06 and abs(apart + p / (1 - p)) < 0.06
    assert abs(blocks[4].sum(1).var() - n * p * (1 - p)) < 0.1 * n * p
    by_place = whole.sum(axis=0)
    assert ((by_place - draws) ** 2 / draws).sum() == pytest.approx(n, abs=5 * (2 * n) ** 0.5)


def test_many_blocks_and_units_add_up_to_plain_weights(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=700), "b": rng.normal(size=5), "c": rng.normal(size=129)}
    rows = [(g, f"i{k:04d}", float(x)) for g, xs in groups.items() for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, item_id string, v double").repartition(6)
    got = resample.sums(df, ["g"], "item_id", {"v": F.col("v"), "one": F.lit(1.0)}, 90, 11, size=32, unit=3, at_once=40).collect()
    assert len(got) == 3 * 90
    for r in got:
        xs, first = groups[r.g], r.draw // 40 * 40
        w = np.concatenate([resample.weights(len(xs), b, min(32, len(xs) - 32 * b), 11, first, min(40, 90 - first), 32)[r.draw - first] for b in range(-(-len(xs) // 32))])
        assert r.one == len(xs) and r.v == pytest.approx(float(w @ xs))


def test_places_and_quantiles_need_no_window_over_a_group(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.5, 2.5, rng.random(), -rng.random()]), k) for k in range(3000)] + [("lone", 1.0, -1), ("lone", None, -2)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(9)
    got = {r.id: (r.pos, r.n) for r in order.ranked(df, ["g"], ["v", "id"]).collect()}
    for g in ("a", "b", None, "lone"):
        mine = sorted(((v is not None, v), i) for x, v, i in rows if x == g)
        assert [got[i] for _, i in mine] == [(k, len(mine)) for k in range(len(mine))]
    found = order.quantiles(df, ["g"], "v", {"low": 0.025, "mid": 0.5, "top": 1.0})
    for r in found.collect():
        own = [v for x, v, _ in rows if x == r.g and v is not None]
        assert [r.low, r.mid, r.top] == pytest.approx(np.quantile(own, [0.025, 0.5, 1.0]).tolist())
    assert order.ranked(df.limit(0), ["g"], ["id"]).count() == 0


def test_key_sets(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "k string, n int")
    b = spark.createDataFrame([("x", 1), ("z", 3)], "k string, n int")
    keys = ["k", "n"]
    assert [tuple(r) for r in keysets.missing(a, b, keys).collect()] == [("y", 2)]
    assert [tuple(r) for r in keysets.unexpected(a, b, keys).collect()] == [("z", 3)]
    assert [tuple(r) for r in keysets.duplicates(a, keys).collect()] == [("x", 1, 1)]
    assert keysets.surplus(a, keys).first().surplus == 1 and keysets.surplus(a.limit(0), keys).first().surplus == 0
    with pytest.raises(Exception, match="duplicate key"):
        keysets.unique_or_fail(a, keys, "key").collect()
    with pytest.raises(ValueError):
        keysets.batched(a, 0, ["n"], ["k"])
    found = spark.createDataFrame([("d", "i", "original", "t", "p", "a")], "dataset string, item_id string, form_id string, transformation_type string, prompt_text string, canonical_answer string")
    with pytest.raises(Exception, match="missing surface i/lexical"):
        keysets.select_surfaces(found, ["original", "lexical"]).collect()
    assert keysets.select_surfaces(found, ["original", "lexical"], strict=False).count() == 2


def test_last_judgment_wins(spark):
    scored = spark.createDataFrame([("a", None, "pending"), ("b", False, "pending"), ("c", True, "not_required")], "k string, correctness boolean, judge_status string")
    judged = spark.createDataFrame([("a", 0, True, False, False), ("a", 1, True, True, False), ("b", 0, True, True, False), ("b", 1, False, None, True)], "k string, position int, parse_ok boolean, equivalent boolean, uncertain boolean")
    got = {r.k: (r.correctness, r.judge_status) for r in adjudicate.apply_judgments(scored, judged, ["k"]).collect()}
    assert got == {"a": (True, "decided"), "b": (None, "uncertain"), "c": (True, "not_required")}


def test_audit_fails_on_uncertain_or_invalid(spark):
    make = lambda rows: spark.createDataFrame(rows, "audit_id int, equivalence string, transformation_label_correct string")
    good = [(k, "equivalent", "yes") for k in range(40)]
    assert adjudicate.audit_report(make(good)).first().passed
    assert not adjudicate.audit_report(make([*good, (99, "uncertain", "yes")])).first().passed
    assert adjudicate.audit_report(make([*good, (99, "maybe", "yes")])).first().invalid_rows == 1
    assert not adjudicate.audit_report(make([])).first().passed


def test_result_gates_are_strict(spark):
    rows = [row(f"i{k}", "original", None if k < 2 else True) for k in range(100)]
    got = {r.gate: r.failed for r in adjudicate.result_gates(table(spark, rows), C.KEY, ["mode", "method"]).collect()}
    assert got == {"duplicate_keys": False, "truncation_rate": False, "undecided_rate": False, "format_violation_rate": False}
    got = {r.gate: r.failed for r in adjudicate.result_gates(table(spark, [*rows, rows[0]]), C.KEY, ["mode", "method"]).collect()}
    assert got["duplicate_keys"] and got["undecided_rate"]


def test_interventions(spark):
    df = spark.createDataFrame([("t", 0, 0, 1, [1.0, 1.0, 0.0]), ("t", 1, 0, 2, [3.0, 1.0, 0.0]), ("t", 2, 0, 2, [3.0, 1.0, 0.0])], "item string, position long, form_no int, actual int, logits array<double>")
    scores = interventions.position_scores(df)
    best = interventions.critical(scores).first()
    total = math.exp(3) + math.e + 1
    assert best.critical_position == 1 and best.critical_score == pytest.approx((math.exp(3) - 1) / total, abs=1e-8)
    special = spark.createDataFrame([("t", 1)], "item string, position long")
    assert interventions.critical(scores, special).first().critical_position == 2
    top = df.select("position", interventions.candidates("actual", interventions.top_tokens("logits", 3), 2).alias("c")).orderBy("position").collect()
    assert [r.c for r in top] == [[1, 0], [2, 0], [2, 0]]
    rollouts = spark.createDataFrame([("t", 0, None, 5.0), ("t", 1, "b", 1.0), ("t", 2, "a", 0.5), ("t", 3, "a", 0.5), ("u", 0, None, 1.0)], "item string, rollout_index long, parsed_answer string, weight double")
    got = {r.item: (r.selected_index, r.selected_answer, r.consistency) for r in interventions.select_rollout(rollouts).collect()}
    assert got == {"t": (2, "a", 1.0), "u": (0, None, 0.0)}
    votes = spark.createDataFrame([("a", "2", True), ("a", "1", False), ("b", None, True), ("b", None, None)], "i string, parsed_answer string, correctness boolean")
    assert {r.i: (r.sc_majority, r.sc_correctness) for r in interventions.plain_majority(votes, ["i"]).collect()} == {"a": ("1", False), "b": (None, True)}


def test_splits_are_disjoint_and_repeat(spark):
    rows = spark.createDataFrame([("d", f"i{k}") for k in range(20)], "dataset string, item_id string")
    counts = {"smoke": 2, "pilot": 3, "confirmatory": 5}
    got = {r.item_id: r.split for r in requests.split_by_hash(rows, counts).collect()}
    assert Counter(got.values()) == Counter(counts)
    assert got == {r.item_id: r.split for r in requests.split_by_hash(rows.repartition(7), counts).collect()}
    shuffled = requests.split_by_shuffle({"d": 20}, counts)
    order = list(range(20))
    random.Random(f"{C.SPLIT_SEED}:d").shuffle(order)
    assert shuffled["d"] == dict(zip(order, ["smoke"] * 2 + ["pilot"] * 3 + ["confirmatory"] * 5))
    with pytest.raises(ValueError):
        requests.split_by_shuffle({"d": 9}, counts)


def test_lifecycle():
    sha = "0" * 40
    assert lifecycle.pinned(None, {"m": sha}, "m") == sha
    with pytest.raises(RuntimeError):
        lifecycle.pinned("main", {}, "m")
    assert lifecycle.stage_errors("pilot", {"smoke": True, "pilot": True}, {"m": sha}, True) == []
    assert len(lifecycle.stage_errors("confirmatory", {}, {"m": "main"}, False)) == 4
    with pytest.raises(FileExistsError):
        lifecycle.refuse_existing(True, False, "manifest")
    with pytest.raises(ValueError):
        lifecycle.check_arguments("controlled", "smoke")
    config = {"primary": [("model", "a", None)], "embedding": [("model", "e", None)], "generator": [("model", "p", None)]}
    assert [a[1] for a in lifecycle.artifacts("intervention", config)] == ["a", "e"]
    assert [a[1] for a in lifecycle.artifacts("all", config)] == ["a", "p", "e"]


def test_whole_analysis(spark, sf_dir):
    from robusteval.sources import fixtures

    rows = fixtures.scored(spark, sf_dir)
    out = analysis.report(analysis.analyze(rows, resamples=20))
    assert 0 < out["math_500/thinking/main"]["main.robust_accuracy"] < 1
    assert "token_matched.final_accuracy" in out["math_500/non_thinking/sc_8"]
    assert sum("tests.holm_adjusted_pvalue" in v for v in out.values()) == 14
    with pytest.raises(ValueError, match="undecided"):
        analysis.analyze(fixtures.scored(spark, sf_dir, undecided=True))


def test_the_whole_plan_is_sorted(spark, sf_dir):
    from robusteval import catalog

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # a plan of more than 500 rows
    rows = [tuple(r) for r in catalog.QUERIES["srt_plan_whole"](spark, sf_dir).collect()]
    kept = keysets.select_surfaces(catalog.found(spark, sf_dir), C.MAIN_FORMS).select("dataset", "item_id", "form_order", "form_id").collect()
    assert rows == sorted(tuple(r) for r in kept)
    assert len(rows) == len(kept) > 500


def test_a_group_of_nulls_has_no_interval(spark):
    df = spark.createDataFrame([("a", "1", None), ("a", "2", None), ("b", "1", 1.0), ("b", "2", None)], "g string, item_id string, v double")
    got = {r.g: (r.mean_low, r.mean_high) for r in resample.mean(df.withColumn("w", F.lit(1)), ["g"], "item_id", "v", 50).collect()}
    assert got == {"a": (None, None), "b": (1.0, 1.0)}


def test_a_lock_tells_which_range_changed(spark):
    rows = [("d", "pilot", f"i{k:03d}") for k in range(100)] + [("e", "smoke", "x")]
    frame = lambda r: spark.createDataFrame(r, "dataset string, split string, item_id string").repartition(4)
    one, again = (sorted(map(tuple, requests.lock(frame(r), 10, 3).collect())) for r in (rows, rows[::-1]))
    assert one == again and [r[:3] for r in one] == [("d", "pilot", 100), ("e", "smoke", 1)]
    changed = [r if r[2] != "i042" else ("d", "pilot", "i042b") for r in rows]
    other = sorted(map(tuple, requests.lock(frame(changed), 10, 3).collect()))
    assert other[0][3] != one[0][3] and other[1] == one[1]
    found = requests.lock_changes(requests.lock_ranges(frame(rows), 10), requests.lock_ranges(frame(changed), 10)).collect()
    assert [(r.part, r.first_id, r.last_id) for r in found] == [(4, "i040", "i049")]
    assert requests.lock(frame(rows).limit(0)).count() == 0
