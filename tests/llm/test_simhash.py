import random

import pytest
import xxhash
from pyspark.sql import functions as F

from robusteval.llm import simhash


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: list of (id, fp) with ids present."""
    ids = [i for i, _ in fps]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for k in range(len(fps)):
        low[root(k)] = min(low.get(root(k), ids[k]), ids[k])
    return {ids[k]: low[root(k)] for k in range(len(fps))}


TEXTS = ["", None, " \t\n", "One", "ONE", "one two", "É é x y", "a b c d", "A b\x0bC  d\n", "z " * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_matches_its_definition(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == brute_fp(text)


def test_ring_finds_every_pair_within_three_bits():
    rng = random.Random(5)
    budgets = [length * 3 // 8 for length in range(1, 9)]
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randint(0, 3))
        seg = [sum(b // 8 == s for b in bits) for s in range(8)]
        assert any(all(sum(seg[(s + k) % 8] for k in range(length)) <= budgets[length - 1] for length in range(1, 9)) for s in range(8))


def test_links_equal_brute_force_with_hot_keys(spark):
    rng = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(12)}
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    want = brute_components(rows)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "id long, fp long").repartition(5)
    from robusteval.llm.common import components

    for block in (20, 512):
        got = {r.id: r.component for r in components(simhash.near_links(df, block=block)).collect()}
        assert {i: got.get(i, i) for i, _ in rows} == want


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, brute_fp(r.text)) for r in docs]
    want = brute_components(fps)
    got = {r.doc_id: r for r in simhash.op3_simhash(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    assert {i: got[i].fingerprint for i, _ in fps} == {i: f"{f:016x}" for i, f in fps}
    assert {i: got[i].component_id for i in got} == want


def test_edge_rows(spark):
    rows = [(3, "a b c d", "x"), (3, "a b c d", "x"), (1, "a b c d", None), (None, "a b c d", "y"), (7, None, "y"), (5, "", None), (None, "only here", None), (9, "w " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([("3", 1), ("3", 1), ("1", 1), ("None", 1), ("7", 5), ("5", 5), ("None", None), ("9", 9)], key=str)
    kept = simhash.keep_representatives(docs)
    assert sorted(str(r.doc_id) for r in simhash.keep_representatives(docs, few=0).collect()) == ["1", "5", "9", "None", "None"]
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "9", "None", "None"]
    assert simhash.near_duplicates(docs.filter(F.lit(False))).count() == 0


def test_one_row_of_a_repeated_id_stays_and_no_group_is_lost(spark):
    rows = [(1, "a b c d e"), (3, "a b c d e"), (3, "quite another text stands here"), (3, "quite another text stands here"), (3, "quite another text stands here"), (4, "a third one of no group at all")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `a.b` int")
    for few in (0, 100):
        kept = simhash.keep_representatives(docs, few=few)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == [rows[0], rows[2], rows[5]]


def test_rows_without_an_id_connect_others(spark):
    """Fingerprints a, c and b lie in a row, c only on a row without an id."""
    fps = {1: 0, None: 0b111, 2: 0b111111, 3: 0xFFFF << 40}
    rows = spark.createDataFrame(list(fps.items()), "id long, fp long")
    marks = rows.select("id", "fp", F.lit(0).cast("long").alias("text_hash"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "fingerprints", lambda *_: marks)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, "id", "fp").collect()}
    assert got == {1: 1, None: 1, 2: 1, 3: 3}
    lone = spark.createDataFrame([(None, 5), (None, 5)], "id long, fp long").select("id", "fp", F.lit(0).cast("long").alias("text_hash"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "fingerprints", lambda *_: lone)
        assert [r.component_id for r in simhash.near_duplicates(lone, "id", "fp").collect()] == [None, None]
