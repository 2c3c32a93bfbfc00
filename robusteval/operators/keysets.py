"""Key sets: missing, unexpected and repeated keys, resuming, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from robusteval.operators.order import ranked


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are expected but not there."""
    return expected.select(*keys).distinct().join(actual.select(*keys), keys, "left_anti")


def unexpected(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return missing(actual, expected, keys)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often beyond the first."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1")
    return counts.select(*keys, (F.col("c") - 1).alias("surplus"))


def surplus(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat a key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("surplus"))


def repeats(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each occurrence of a key after its first."""
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn("occurrence", F.row_number().over(w)).filter("occurrence > 1").select(*keys, "occurrence")


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The plan's rows without a completed key."""
    return plan.join(done.select(*keys), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return picked.select(*keys, "__r.*")


def unique_or_fail(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """rows; the query stops if a key occurs twice."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__c"))
    checked = counts.filter(F.when(F.col("__c") > 1, F.raise_error(F.lit(f"duplicate {what}"))).otherwise(F.lit(True)))
    return rows.join(checked.drop("__c"), keys, "left_semi")


def examples(keys: DataFrame, order: list[str], most: int = 25) -> DataFrame:
    return keys.orderBy(*order).limit(most)


def batched(rows: DataFrame, size: int, order: list[str], by: list[str]) -> DataFrame:
    """rows with their batch number within a bucket: consecutive batches of a size,
    from the rows' places in order, however large a bucket is."""
    if size <= 0:
        raise ValueError("batch size must be above zero")
    return ranked(rows, by, order).withColumn("batch", F.floor(F.col("pos") / size).cast("long")).drop("pos", "n")


def surfaces(manifest: DataFrame, rewordings: DataFrame, split: str) -> DataFrame:
    """Originals and rewordings of a split as prompt texts; a key twice stops it."""
    keys = ["dataset", "item_id", "form_id"]
    own = manifest.filter(F.col("split") == split).select("dataset", "item_id", F.lit("original").alias("form_id"), F.lit("original").alias("transformation_type"), F.col("original_text").alias("prompt_text"), "canonical_answer")
    more = rewordings.filter(F.col("split") == split).select(*keys, "transformation_type", F.col("rewording_text").alias("prompt_text"), "canonical_answer")
    return unique_or_fail(own.unionByName(more), keys, "surface")


def expected_pairs(manifest: DataFrame, forms: list[str], split: str) -> DataFrame:
    """Items of a split times the forms to make, without a join."""
    return manifest.filter(F.col("split") == split).select("dataset", "item_id", F.explode(F.array(*[F.lit(f) for f in forms])).alias("form_id"))


def select_surfaces(found: DataFrame, forms: list[str], strict: bool = True) -> DataFrame:
    """The asked forms of every item in plan order; a missing one stops the query,
    or, if not strict, has no text."""
    listed = F.array(*[F.lit(f) for f in forms])
    asked = found.filter("form_id = 'original'").select("dataset", "item_id", F.posexplode(listed).alias("form_order", "form_id"))
    joined = asked.join(found, ["dataset", "item_id", "form_id"], "left")
    if not strict:
        return joined
    whole = F.when(F.col("prompt_text").isNull(), F.raise_error(F.concat(F.lit("missing surface "), "item_id", F.lit("/"), "form_id"))).otherwise(F.col("prompt_text"))
    return joined.withColumn("prompt_text", whole)
