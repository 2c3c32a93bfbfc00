import zlib
from collections import Counter

import numpy as np

from robusteval.llm import sharding


def one(key, buckets):
    """The published algorithm, one key at a time."""
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_algorithm_and_moves_only_into_the_new_shard():
    keys = np.r_[np.arange(3000), 2**63 + np.arange(50, dtype=np.uint64), [2**64 - 1]].astype(np.uint64)
    for n in (1, 2, 7, 40, 41):
        assert sharding.jump_hash(keys, n).tolist() == [one(int(k), n) for k in keys]
    old, new = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    moved = old != new
    assert (new[moved] == 40).all() and 0.5 / 41 < moved.mean() < 2 / 41


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        assert r.law == "key"
        assert r.shard == one((r.doc_id or 0) % (1 << 64), 40)
        assert r.grown_shard == one((r.doc_id or 0) % (1 << 64), 41)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    got = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert got == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)


def test_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(sharding.op7_jump_sharding(spark, sf_dir).collect(), texts)


def test_edge_rows(spark):
    rows = [(None, None), (None, "x"), (-5, "é"), (7, ""), (7, ""), (7, "z" * 100000)]
    df = spark.createDataFrame([(i, t, 9, "s") for i, t in rows], "doc_id long, text string, slot int, shard string")
    check(sharding.shard_rows(df, 40).collect(), rows)
    check(sharding.shard_rows(df, 40, bucket_rows=1).collect(), rows)
    assert sharding.shard_rows(df.limit(0), 40).count() == 0


def test_slots_have_no_gap_if_one_row_is_repeated_over_and_over(spark):
    docs = spark.createDataFrame([(None, None)] * 900 + [(7, "x")] * 900 + [(k, f"t{k}") for k in range(200)], "doc_id long, text string").repartition(6)
    rows = sharding.shard_rows(docs, 3, bucket_rows=20).collect()
    assert len(rows) == 2000
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
