"""Places in a global order, and what rests on them, without a window over a group.

Rows are range-partitioned by group and order, and every partition numbers its own
rows; the counts of groups by partition, a few rows, give the places where each
partition's part of a group begins. So one task never holds a group, however large,
and rows move once. The numbered rows are written to the folder the machines share:
both uses read the same partitioning, and a lost executor repeats nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from robusteval.sources.files import shared_folder


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality of columns, nulls equal to nulls."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with pos, their place in the group from 0, and n, the group's size. Ties
    that order leaves are numbered in any order."""
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id())
    path = shared_folder(rows.sparkSession, "ranked")
    dealt.write.parquet(path)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(path).withColumn("__part", F.shiftright("__at", 33))
    runs = dealt.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__count"))
    group = W.partitionBy(*by)
    before = F.sum("__count").over(group.orderBy("__part")) - F.col("__count")
    names = {c: f"__g{k}" for k, c in enumerate([*by, "__part"])}
    runs = runs.select(*[F.col(c).alias(a) for c, a in names.items()], (before - F.col("__first")).alias("__shift"), F.sum("__count").over(group).alias("n"))
    found = dealt.join(runs, same(dealt, runs, list(names.items())))
    return found.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("pos"), "n")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column per share): exact quantiles with linear interpolation between the
    two rows around each. Null values don't count."""
    placed = ranked(rows.filter(F.col(value).isNotNull()).select(*by, value), by, [value])
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("n") - 1)
        below, above = F.floor(at), F.ceil(at)
        low, high = (F.max(F.when(F.col("pos") == p, F.col(value))) for p in (below, above))
        out.append((low + (high - low) * F.max(at - below)).alias(name))
    wanted = reduce(lambda a, b: a | b, [(F.col("pos") >= F.floor(F.lit(s) * (F.col("n") - 1))) & (F.col("pos") <= F.ceil(F.lit(s) * (F.col("n") - 1))) for s in shares.values()])
    return placed.filter(wanted).groupBy(*by).agg(*out)
