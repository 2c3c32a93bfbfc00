"""The whole analysis of scored rows as a handful of report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval.operators import budget, metrics, resample, stats
from robusteval.operators.adjudicate import guard_decided


def analyze(scored: DataFrame, resamples: int = C.BOOTSTRAP_RESAMPLES, seed: int = C.BOOTSTRAP_SEED) -> dict[str, DataFrame]:
    """Reports by name: main, layers, main_intervals, variance_intervals, fixed,
    token_matched, costs, latency, tests. Scored rows must all be decided."""
    guard = guard_decided(scored).first()
    if not guard.may_analyze:
        raise ValueError(f"{guard.n_undecided} of {guard.n_rows} rows are undecided: complete adjudication first")
    main = scored.filter(F.col("method").isin(C.MAIN_METHODS))
    fixed = scored.filter(~F.col("method").isin(C.MAIN_METHODS))
    forms = metrics.item_forms(main)
    items = metrics.item_robustness(forms)
    votes = metrics.item_votes(fixed)
    tests = stats.compare_modes(items).unionByName(stats.compare_methods(votes))
    return {
        "main": metrics.main_metrics(main),
        "layers": metrics.layer_metrics(main),
        "main_intervals": resample.mean(items, metrics.BY, "item_id", "mean_correctness", resamples, seed),
        "variance_intervals": resample.variance(stats.item_variances(forms, metrics.BY), metrics.BY, resamples, seed),
        "fixed": metrics.fixed_budget(fixed),
        "token_matched": metrics.fixed_budget(budget.token_match(scored)),
        "costs": metrics.costs(scored),
        "latency": metrics.latency(scored),
        "tests": stats.holm(tests),
    }


def report(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """The small report tables on the driver, NaN and infinity as null."""
    clean = lambda v: None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v
    out: dict[str, dict] = {}
    for name, table in tables.items():
        for row in table.collect():
            values = {k: clean(v) for k, v in row.asDict().items()}
            key = "/".join(str(values.pop(k)) for k in [*metrics.BY, "layer", "comparison"] if k in values)
            out.setdefault(key, {}).update({f"{name}.{k}": v for k, v in values.items()})
    return out
