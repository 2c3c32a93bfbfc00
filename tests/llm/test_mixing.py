import math
from collections import Counter

import pytest

from robusteval.llm import mixing


def brute_targets(sizes):
    """sizes by source; the rule by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        share = {s: (left - sum(fixed.values())) * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2 * sizes[s] for s in over}


def words(text):
    return len((text or "").encode().split())


def check(rows, docs, near=None):
    """docs: (doc_id, text, source)."""
    sizes, largest = {}, {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = brute_targets(sizes)
    by_id = {}
    for i, t, s in docs:
        by_id.setdefault(i, (words(t), s))
    taken = {}
    assert len(rows) == len(docs)
    for r in rows:
        n, s = by_id[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s])
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), n)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (near if near is not None else largest[s])


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = mixing.op9_entropy_mix(spark, sf_dir).collect()
    check(rows, docs)
    again = mixing.op9_entropy_mix(spark, sf_dir).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_close_to_targets_with_a_hot_source_and_long_documents(spark):
    docs = [(i, "w " * (1 + i * 7919 % 400) if i % 500 else "w " * 20000, "abc"[i % 3] if i % 2 else "hot") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    check(mixing.mix(df).collect(), docs, near=60)


def test_null_and_repeated_ids_come_near_their_targets(spark):
    docs = [(None, "w " * (1 + k % 90) + str(k), "a") for k in range(2000)] + [(7, "w " * (1 + k % 90) + str(k), "b") for k in range(2000)]
    docs += [(8, "one two three four", "c") for _ in range(3000)] + [(k, "other words here", "d") for k in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    sizes, taken = {}, {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = brute_targets(sizes)
    by_target = {t: s for s, t in want.items()}
    for r in rows:
        s = min(by_target, key=lambda t: abs(t - r.target))
        taken[by_target[s]] = taken.get(by_target[s], 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.005 * want[s]
    got = [(r.doc_id, r.text) for r in mixing.take_copies(df).collect()]
    assert sum(words(t) for _, t in got) == sum(taken.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))


def test_edge_rows(spark):
    docs = [(None, None, None), (1, "", "a"), (2, "x y", "é"), (2, "x y", "é"), (3, "one", "Z"), (4, "b " * 50000, None), (5, "q r", "empty-ish")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, size int, rate int")
    check(mixing.mix(df).collect(), docs)
    copies = {str(r.doc_id): r.copies for r in mixing.mix(df).collect()}
    out = mixing.take_copies(df)
    assert out.columns == df.columns
    got = [str(r.doc_id) for r in out.collect()]
    assert all(got.count(k) == n * sum(str(d[0]) == k for d in docs) for k, n in copies.items())
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.take_copies(df.limit(0)).count() == 0


def test_two_margins_reach_both(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 40), ("b", "y", 20)], "source string, lang string, size long")
    targets = {"source": {"a": 50.0, "b": 50.0}, "lang": {"x": 30.0, "y": 70.0}}
    lam = mixing.entropy_balance(cells, ["source", "lang"], targets)
    got = {}
    for r in cells.collect():
        mass = r["size"] * math.exp(lam["source"][r.source] + lam["lang"][r.lang])
        for k in (r.source, r.lang):
            got[k] = got.get(k, 0) + mass
    assert got == pytest.approx({"a": 50, "b": 50, "x": 30, "y": 70}, rel=1e-6)


def test_no_python_on_executors(spark, sf_dir):
    plan = mixing.op9_entropy_mix(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_one_text_in_two_sources_gets_the_same_copies_on_any_partitioning(spark):
    rows = [(k, f"text {k} " * (k % 9 + 1), s) for k in range(600) for s in ("a", "b")] + [(5000 + k, f"other {k} " * (k % 7 + 1), "ab"[k % 2]) for k in range(900)] + [(k, f"text {k} " * (k % 9 + 1), "a") for k in range(0, 600, 50)]
    results, taken = [], []
    for parts, order in ((1, rows), (7, rows[::-1]), (5, rows[::3] + rows[1::3] + rows[2::3])):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(parts)
        by_source = mixing.mix(docs).collect()
        results.append(Counter((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in by_source))
        taken.append(Counter(map(tuple, mixing.take_copies(docs).collect())))
    assert results[0] == results[1] == results[2]
    assert taken[0] == taken[1] == taken[2]
