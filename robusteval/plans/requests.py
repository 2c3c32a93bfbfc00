"""Request plans: splits, samples of items, and the rows each experiment asks for."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval.functions.keys import hash_order, object_fingerprint, stable_seed
from robusteval.operators.keysets import select_surfaces
from robusteval.operators.order import ranked


def split_by_hash(rows: DataFrame, counts: dict[str, int], seed: int = C.SPLIT_SEED) -> DataFrame:
    """The first rows of each data set in hash order, in the splits' sizes; the rest
    of a data set is left out. Only keys are ordered; rows follow by a join."""
    place = F.row_number().over(W.partitionBy("dataset").orderBy(hash_order(seed, "dataset", "item_id"), "item_id"))
    keys = rows.select("dataset", "item_id").withColumn("place", place)
    bound, split = 0, F.lit(None)
    edges = []
    for name, n in counts.items():
        edges.append((bound, bound + n, name))
        bound += n
    for low, high, name in reversed(edges):
        split = F.when((F.col("place") > low) & (F.col("place") <= high), F.lit(name)).otherwise(split)
    chosen = keys.filter(F.col("place") <= bound).select("dataset", "item_id", split.alias("split"))
    return rows.join(chosen, ["dataset", "item_id"])


def split_by_shuffle(sizes: dict[str, int], counts: dict[str, int], seed: int = C.SPLIT_SEED) -> dict[str, dict[int, str]]:
    """Split of each source index by the seeded shuffle of the standard library: the
    parity form, for data sets whose indexes fit the driver."""
    out: dict[str, dict[int, str]] = {}
    for dataset, n in sizes.items():
        if n < sum(counts.values()):
            raise ValueError(f"{dataset} has {n} rows, fewer than its splits need")
        order = list(range(n))
        random.Random(f"{seed}:{dataset}").shuffle(order)
        names = [name for name, k in counts.items() for _ in range(k)]
        out[dataset] = dict(zip(order, names))
    return out


def stratified(rows: DataFrame, total: int, seed: int = C.EXTERNAL_SEED) -> DataFrame:
    """Items per data set in hash order: equal quotas, one more for the first data
    sets in order until the total is met."""
    strata = rows.select("dataset").distinct()
    ranked = strata.withColumn("idx", F.row_number().over(W.orderBy("dataset")) - 1).withColumn("k", F.count("*").over(W.partitionBy()))
    quota = F.floor(F.lit(total) / F.col("k")) + F.when(F.col("idx") < F.lit(total) % F.col("k"), 1).otherwise(0)
    place = F.row_number().over(W.partitionBy("dataset").orderBy(hash_order(seed, "dataset", "item_id"), "item_id"))
    keys = rows.select("dataset", "item_id").withColumn("place", place)
    # No quota is above the total: with the constant, each task sends that many keys at most.
    top = keys.filter(F.col("place") <= total)
    return top.join(ranked.select("dataset", quota.alias("quota")), "dataset").filter("place <= quota").select("dataset", "item_id")


def first_items(rows: DataFrame, count: int, seed: int) -> DataFrame:
    """A simple sample in hash order: a top-k, not a sort of all rows."""
    return rows.orderBy(hash_order(seed, "item_id"), "item_id").limit(count)


def item_forms(found: DataFrame, items: DataFrame, forms: list[str]) -> DataFrame:
    """Each item's texts in the given order of forms."""
    chosen = select_surfaces(found.join(items.select("dataset", "item_id"), ["dataset", "item_id"], "left_semi"), forms)
    listed = F.array_sort(F.collect_list(F.struct("form_order", "form_id", "prompt_text")))
    return chosen.groupBy("dataset", "item_id").agg(listed.alias("forms"))


def audit_sample(pairs: DataFrame, seed: int = C.BOOTSTRAP_SEED, buckets: int = 4096) -> DataFrame:
    """A tenth of the pairs, eighty at least, numbered in hash order: pairs fall into
    buckets by the beginning of their hash, whose counts give each bucket's first
    number, so no task orders all pairs."""
    count = F.greatest(F.lit(C.AUDIT_MIN_PAIRS), F.ceil(F.col("all") * 10 / 100))
    order = hash_order(seed, "dataset", "item_id", "form_id")
    part = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int")
    rows = pairs.select("dataset", "item_id", "form_id", "transformation_type", order.alias("order")).withColumn("part", part)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("before"), F.sum("n").over(W.partitionBy()).alias("all")).filter(F.col("before") < count)
    place = F.row_number().over(W.partitionBy("part").orderBy("order", "dataset", "item_id", "form_id"))
    numbered = rows.join(sizes, "part").withColumn("place", place + F.col("before")).filter(F.col("place") <= count)
    return numbered.select("dataset", "item_id", "form_id", "transformation_type", F.format_string("audit-%04d", "place").alias("audit_id"))


def audit_sheet(pairs: DataFrame) -> DataFrame:
    """The sample's texts with empty columns for the auditor, in order of number."""
    keys = ["dataset", "item_id", "form_id", "transformation_type"]
    texts = pairs.withColumnRenamed("rewording_text", C.REWORDING_TEXT)
    rows = audit_sample(pairs).join(texts.select(*keys, "original_text", C.REWORDING_TEXT), keys)
    blank = ["equivalence", "transformation_label_correct", "notes"]
    return rows.select(*[F.lit("").alias(c) if c in blank else F.col(c) for c in C.AUDIT_SHEET]).orderBy("audit_id")


def with_run(rows: DataFrame, mode: str, protocol: str) -> DataFrame:
    return rows.withColumn("mode", F.lit(mode)).withColumn("protocol", F.lit(protocol))


def each_seed(rows: DataFrame, method: str) -> DataFrame:
    seeds = F.array(*[F.lit(s).cast("long") for s in C.SAMPLING_SEEDS])
    return rows.select("*", F.explode(seeds).alias("seed")).withColumn("method", F.lit(method))


def main_plan(found: DataFrame, mode: str, protocol: str, strict: bool = True) -> DataFrame:
    """Every item in the main forms, once per sampling seed."""
    return each_seed(with_run(select_surfaces(found, C.MAIN_FORMS, strict), mode, protocol), "main")


def method_samples() -> Column:
    """array of (method, form_id, n): which forms a method samples how often."""
    each = [F.struct(F.lit(name).alias("method"), F.lit(form).alias("form_id"), F.lit(n).alias("n")) for name, forms, n in C.METHODS for form in forms]
    return F.array(*each)


def budget_plan(found: DataFrame, mode: str, protocol: str, strict: bool = True) -> DataFrame:
    """The fixed-budget methods' forms and samples of every item, with their seeds."""
    chosen = select_surfaces(found, C.FORM_IDS, strict).withColumnRenamed("form_id", "own_form")
    mine = F.filter(method_samples(), lambda m: m["form_id"] == F.col("own_form"))
    rows = chosen.select("*", F.inline(mine)).drop("own_form", "form_order")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sample_index")).drop("n")
    return with_run(rows, mode, protocol).withColumn("seed", stable_seed(F.lit(C.RUN_SEED), "method", "item_id", "form_id", "sample_index"))


def external_plan(found: DataFrame, total: int, mode: str, protocol: str, strict: bool = True) -> DataFrame:
    """A stratified sample of items in the main forms, once per sampling seed."""
    items = stratified(found.filter("form_id = 'original'"), total)
    rows = select_surfaces(found, C.MAIN_FORMS, strict).join(items, ["dataset", "item_id"], "left_semi")
    return each_seed(with_run(rows, mode, protocol), "external_main")


def make_plan(experiment: str, found: DataFrame, mode: str, protocol: str, total: int = 200) -> tuple[DataFrame, str]:
    """The plan of an experiment and the fingerprint of all that shaped it."""
    builders = {
        "main": lambda: main_plan(found, mode, protocol),
        "scop": lambda: budget_plan(found, mode, protocol),
        "external": lambda: external_plan(found, total, mode, protocol),
    }
    if experiment not in builders:
        raise ValueError(f"no experiment named {experiment!r}")
    settings = {"experiment": experiment, "mode": mode, "protocol": protocol, "total": total, "run_seed": C.RUN_SEED, "seeds": C.SAMPLING_SEEDS, "methods": C.METHODS}
    return builders[experiment](), object_fingerprint(settings)


#: Ranges that the ids of a split are cut into, of about so many ids each.
LOCK_RANGE = 1000


def lock_ranges(rows: DataFrame, size: int = LOCK_RANGE) -> DataFrame:
    """(dataset, split, part, first_id, last_id, n, digest): the leaves of the lock, one
    for each range of ids in order, with the digest of its ids joined by newlines."""
    placed = ranked(rows.select("dataset", "split", "item_id"), ["dataset", "split"], ["item_id"])
    leaf = placed.groupBy("dataset", "split", F.floor(F.col("pos") / size).alias("part"))
    ids = F.array_sort(F.collect_list("item_id"))
    made = leaf.agg(ids.alias("ids"))
    return made.select("dataset", "split", "part", F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"), F.size("ids").cast("long").alias("n"), F.sha2(F.array_join("ids", "\n"), 256).alias("digest"))


def lock_tree(leaves: DataFrame, fan: int = 16) -> DataFrame:
    """(dataset, split, level, part, n, digest) of all nodes: a node's digest is that of
    its children's, in order. Levels are added until every split has one root."""
    level = leaves.select("dataset", "split", F.lit(0).alias("level"), "part", "n", "digest")
    tree, height, widest = level, 0, leaves.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    while widest > 1:
        height, widest = height + 1, -(-widest // fan)
        children = F.array_sort(F.collect_list(F.struct("part", "digest")))
        above = level.groupBy("dataset", "split", F.floor(F.col("part") / fan).alias("part")).agg(F.sum("n").alias("n"), children.alias("c"))
        level = above.select("dataset", "split", F.lit(height).alias("level"), "part", "n", F.sha2(F.array_join(F.transform("c", lambda x: x["digest"]), "\n"), 256).alias("digest"))
        tree = tree.unionByName(level)
    return tree


def lock(rows: DataFrame, size: int = LOCK_RANGE, fan: int = 16) -> DataFrame:
    """(dataset, split, n, root): a frozen split's size and the digest over all its ids,
    from a tree of digests, so that no row or task holds all ids."""
    tree = lock_tree(lock_ranges(rows, size), fan)
    return tree.groupBy("dataset", "split").agg(F.max_by("n", "level").alias("n"), F.max_by("digest", "level").alias("root"))


def lock_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(dataset, split, part, first_id, last_id): ranges of the present ids that differ
    from the locked ones, from two tables of leaves; ids are named by range only."""
    on = ["dataset", "split", "part"]
    old = before.select(*on, F.col("digest").alias("locked"), F.col("first_id").alias("old_first"), F.col("last_id").alias("old_last"))
    both = now.select(*on, "digest", "first_id", "last_id").join(old, on, "full").filter(~F.col("digest").eqNullSafe(F.col("locked")))
    return both.select(*on, F.coalesce("first_id", "old_first").alias("first_id"), F.coalesce("last_id", "old_last").alias("last_id"))
