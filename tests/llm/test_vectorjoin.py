import math

import numpy as np

from robusteval.llm import vectorjoin


def brute(rows, cosine=0.9):
    """rows: (id, vector). Links and components of vectors as the contract has them."""
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    out = [[i, 0, i] for i, _ in rows]
    for size in {len(v) for (_, v), o in zip(rows, ok) if o}:
        at = [k for k, o in enumerate(ok) if o and len(rows[k][1]) == size]
        x = np.array([rows[k][1] for k in at], dtype=float)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        seen = set()
        for p in range(len(at)):
            out[at[p]][1] = int(linked[p].sum())
            if p in seen:
                continue
            stack, group = [p], {p}
            while stack:
                for q in np.flatnonzero(linked[stack.pop()]):
                    if q not in group:
                        group.add(int(q))
                        stack.append(int(q))
            seen |= group
            low = min((rows[at[q]][0] for q in group if rows[at[q]][0] is not None), default=None)
            for q in group:
                out[at[q]][2] = low
    return sorted(map(str, ((i, n, c, i is not None and i == c) for i, n, c in out)))


def result(df):
    return sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in df.collect())


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert result(vectorjoin.op6_vector_range_join(spark, sf_dir)) == brute(rows)


def test_hot_cells_and_chains(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=8)
    hot = [centre + rng.normal(size=8) * s for s in (0.1, 0.3, 0.5) for _ in range(60)]
    rest = [rng.normal(size=8) for _ in range(200)]
    copies = [hot[0]] * 30 + [2 * hot[1]] * 5
    chain = [[math.cos(a), math.sin(a)] + [0] * 6 for a in np.arange(0, 3, 0.4)]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate([*hot, *rest, *copies, *chain])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), list(map(float, v))) for i, v in rows], "vec_id long, embedding array<double>")
    want = brute([(int(i), list(map(float, v))) for i, v in rows])
    for pivots, block in (((1,), 50), ((6,), 20), ((3, 12), 4096)):
        assert result(vectorjoin.link_vectors(df, pivots=pivots, block=block)) == want


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (12, [1.0, 0.1, 0.0]), (None, [0.0, 5.0, 0.0]), (10, [1e200, 1e199]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, kept string, links int")
    assert result(vectorjoin.link_vectors(df)) == brute([(i, [c / 1e190 for c in v] if i == 10 else v) for i, v in rows])
    assert vectorjoin.link_vectors(df.limit(0)).count() == 0
    assert result(vectorjoin.link_vectors(df.filter("vec_id in (3, 4)"))) == sorted(map(str, [(3, 0, 3, True), (4, 0, 4, True)]))


def test_links_belong_to_vectors_not_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [1.0, 0.0, 0.1]), (1, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = result(vectorjoin.link_vectors(df))
    assert got == brute(rows)
    assert got.count(str((1, 1, 1, True))) == 2 and got.count(str((1, 2, 1, True))) == 1


def test_every_length_links_within_itself(spark):
    rng = np.random.default_rng(5)
    rows = [(k, list(map(float, v))) for k, v in enumerate([v for n in (2, 3, 7) for v in rng.normal(size=(60 // n, n))])]
    rows += [(100, [1.0, 1.0]), (101, [2.0, 2.0]), (102, [4.0]), (103, [5.0]), (104, [-5.0]), (7, [1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (4, None):
        assert result(vectorjoin.link_vectors(df, pivots=(2, 4), block=block)) == brute(rows)


def test_structure_gives_more_pivots_and_random_vectors_few():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(200, 64))
    limit = math.acos(0.9)
    close = vectorjoin.unit_rows(centres[rng.integers(0, 200, 2000)] + rng.normal(size=(2000, 64)) * 0.1)
    loose = vectorjoin.unit_rows(rng.normal(size=(2000, 64)))
    assert len(vectorjoin.choose_pivots(close, 10**6, limit, 16384)) >= 256
    assert len(vectorjoin.choose_pivots(loose, 10**6, limit, 16384)) == 16


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(1)
    x = vectorjoin.unit_rows(rng.normal(size=(300, 5)))
    y = vectorjoin.unit_rows(x + rng.normal(size=x.shape) * 0.15)
    pivots = vectorjoin.spread_pivots(x, 9)
    limit = math.acos(0.9)
    both = np.r_[x, y]
    home, angle = vectorjoin.homes(both, pivots)
    radius = np.array([angle[home == c, c].max(initial=0) for c in range(len(pivots))])
    home, near = vectorjoin.reachable(both, pivots, radius, limit)
    a, b = np.nonzero(both @ both.T >= 0.9)
    across = home[a] != home[b]
    assert across.sum() > 50
    assert near[a[across], home[b[across]]].all()
