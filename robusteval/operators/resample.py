"""Resampling by weights: how often each draw takes each item, as exact multinomial
counts that any task can make for its own items.

Items of a group lie in order in blocks. A draw of n items is split down a binary tree
over the blocks: of the c items drawn within a node, those in its left half are
binomially distributed, with the half's share of items, and are drawn from a generator
seeded by (seed, node, range of draws). A task follows the path from the root to its
blocks, so no other task is asked. Within a block each of its drawn items is picked by
a hash of (seed, draw, block, number). The weights, an array (draws, items), multiply
the items' columns, and only their sums leave the task: one row for each range of
draws and unit of blocks. Sums of units merge by addition; items aren't copied, and no
task holds a group.

The hash is plain arithmetic on 32 bits, so SQL can make the same picks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval.operators.order import ranked

#: Multiplier of the hash (a public mixing function of 32 bits; fixed value).
MULTIPLIER = 73_244_475
#: Items of a block, blocks of a unit, draws of a range.
BLOCK, UNIT, DRAWS = 1024, 16, 500


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of unsigned 32-bit numbers."""
    x = x.astype(np.uint32)
    for _ in range(2):
        x = (x >> np.uint32(16) ^ x) * np.uint32(MULTIPLIER)
    return x >> np.uint32(16) ^ x


def drawn_within(n: int, blocks: int, block: int, seed: int, first: int, draws: int, size: int) -> np.ndarray:
    """Items drawn in one block, for the draws from first on: the path from the root."""
    count = np.full(draws, n, dtype=np.int64)
    low, high = 0, blocks
    while high - low > 1:
        middle = (low + high) // 2
        all_items, left_items = min(n, high * size) - low * size, (middle - low) * size
        left = np.random.default_rng([seed, low, high, first]).binomial(count, left_items / all_items)
        low, high, count = (low, middle, left) if block < middle else (middle, high, count - left)
    return count


def weights(n: int, block: int, items: int, seed: int, first: int, draws: int, size: int = BLOCK) -> np.ndarray:
    """How often each of the draws from first on takes each item of a block of n."""
    count = drawn_within(n, -(-n // size), block, seed, first, draws, size)
    base = mixed(mixed(mixed(np.array([seed])) + np.arange(first, first + draws, dtype=np.uint32)) + np.uint32(block))
    row = np.repeat(np.arange(draws), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = mixed(base[row] + nth.astype(np.uint32)).astype(np.int64) % items
    return np.bincount(row * items + place, minlength=draws * items).reshape(draws, items)


def sums(items: DataFrame, by: list[str], order: str, columns: dict[str, Column], resamples: int, seed: int, size: int = BLOCK, unit: int = UNIT, at_once: int = DRAWS) -> DataFrame:
    """(by, draw, the weighted sum of each column) for every draw."""
    names = list(columns)
    placed = ranked(items.select(*by, F.col(order).alias("__order"), *[c.cast("double").alias(name) for name, c in columns.items()]), by, ["__order"])
    placed = placed.withColumn("__unit", F.floor(F.col("pos") / (size * unit)))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*by).schema), "first int", *(f"`{c}` array<double>" for c in names)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n, block = int(pdf["n"].iloc[0]), pdf["pos"].to_numpy() // size
        values = pdf[names].to_numpy()
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        out = []
        for first in range(0, resamples, at_once):
            draws = min(at_once, resamples - first)
            total = np.zeros((draws, len(names)))
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                total += weights(n, int(block[a]), b - a, seed, first, draws, size) @ values[a:b]
            out.append({**{c: pdf[c].iloc[0] for c in by}, "first": first, **{c: total[:, k].tolist() for k, c in enumerate(names)}})
        return pd.DataFrame(out, columns=[*by, "first", *names])

    made = placed.groupBy(*by, "__unit").applyInPandas(run, kinds)
    each = made.select(*by, "first", F.inline(F.arrays_zip(F.sequence(F.lit(0), F.size(names[0]) - 1).alias("nth"), *names)))
    return each.groupBy(*by, (F.col("first") + F.col("nth")).alias("draw")).agg(*[F.sum(c).alias(c) for c in names])


def interval(estimates: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Percentile interval of 95 % of each column, over the draws."""
    aggs = [F.percentile(c, q).alias(f"{c}_{name}") for c in columns for q, name in ((0.025, "low"), (0.975, "high"))]
    return estimates.groupBy(*by).agg(*aggs)


def mean(values: DataFrame, by: list[str], item: str, value: str, resamples: int = C.BOOTSTRAP_RESAMPLES, seed: int = C.BOOTSTRAP_SEED, **how: int) -> DataFrame:
    """(by, mean_low, mean_high) of the mean of value over items; null values are drawn
    but don't count, and a group of nulls has no interval."""
    known = F.col(value).isNotNull()
    found = sums(values, by, item, {"total": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "known": F.when(known, 1.0).otherwise(0.0)}, resamples, seed, **how)
    return interval(found.select(*by, F.try_divide("total", "known").alias("mean")), by, ["mean"])


def variance(items: DataFrame, by: list[str], resamples: int = C.BOOTSTRAP_RESAMPLES, seed: int = C.BOOTSTRAP_SEED, **how: int) -> DataFrame:
    """(by, v_run_low, ... pi_form_high) of items (run, form, item_mean): items are
    resampled, the components recomputed."""
    m = F.col("item_mean")
    found = sums(items, by, "item_id", {"run": F.col("run"), "form": F.col("form"), "m": m, "m2": m * m, "all": F.lit(1.0)}, resamples, seed, **how)
    run, form, item = F.col("run") / F.col("all"), F.col("form") / F.col("all"), F.greatest(F.lit(0.0), F.col("m2") / F.col("all") - F.pow(F.col("m") / F.col("all"), 2))
    out = found.select(*by, run.alias("v_run"), form.alias("v_form"), item.alias("v_item"))
    total = F.col("v_run") + F.col("v_form") + F.col("v_item")
    return interval(out.withColumn("pi_form", F.when(total > 0, F.col("v_form") / total).otherwise(0.0)), by, ["v_run", "v_form", "v_item", "pi_form"])
