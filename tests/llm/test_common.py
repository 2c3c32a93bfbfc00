import random

import numpy as np
from pyspark.sql import functions as F

from robusteval.llm import common


def test_samples_are_the_first_in_hash_order(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "own_id")
    want = {r.own_id for r in ids.orderBy(F.xxhash64("own_id")).limit(300).collect()}
    assert {r.own_id for r in common.hash_order_sample(ids.repartition(7), 300, "own_id").collect()} == want
    assert common.hash_order_sample(ids.limit(5), 300, "own_id").count() == 5


def test_components_of_random_graphs_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(1000 + k, 1001 + k) for k in range(80)] + [(2000, 2001 + k) for k in range(100)] + [(5, 5)]
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    root = common.local_roots(len(nodes), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    want = {x: nodes[root[i]] for x, i in at.items()}
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == linked
    assert got == {x: want[x] for x in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
