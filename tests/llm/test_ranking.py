import math
import random
import re
from collections import Counter

import duckdb

from robusteval.llm import ranking

TERM = re.compile(ranking.TERM)


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans(ranking.UPPER, ranking.LOWER)))


def plain(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, ts) for i, ts in own if ts]
    count, total = len(own), sum(len(ts) for _, ts in own)
    df = Counter(t for _, ts in own for t in set(ts))
    tfs = [Counter(ts) for _, ts in own]
    out = []
    for item, text in items:
        scores = []
        for (i, ts), tf in zip(own, tfs):
            m = 100 - 50 + (50 * len(ts) * count) // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(terms(text)) if tf[t])
            if s > 0:
                scores.append((-s, i is None, i, s))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(scores[:k])]
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(4000)] + ["Éa", "ñ", "中文", "A1", "the", "the", "THE"]
    return [(k, " ".join(rnd.choice(words) + rnd.choice(["", "", ".", "-", "_x"]) for _ in range(rnd.randrange(1, 120)))) for k in range(n)]


def test_terms_of_bytes_equal_the_expression():
    texts = ["Ab1 É-é_x\x00y\x7fz\u0080 ÀB İ ß", "".join(map(chr, range(0x250))), None, "", " ._"]
    assert [[t.decode() for t in ranking.terms_of(x)] for x in texts] == [terms(x) for x in texts]


def test_ranks_equal_plain_scoring_at_every_depth(spark):
    docs = corpus() + [(None, None), (None, "the w1 w2"), (7, "w1 w2 the"), (7, "w1 w2 the"), (8, ""), (9, "  .. "), (10, "w1 " * 20000)]
    items = [(k, t) for k, t in corpus(25, seed=2)] + [(1, "w1 w2"), (None, "w3 THE"), (None, None), (50, ""), (51, "unseen words only"), (52, "the")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    for tiers, block, at_once, k, ahead in (((2, 8), 900, 10**6, 10, 128), ((1,), 200, 100, 50, 4), (ranking.TIERS, 10**6, 10**6, 50, 128), ((4, 40, 100), 3000, 10**6, 3, 1)):
        log = []
        index = ranking.TieredIndex.build(frame, tiers=tiers, block_postings=block)
        got = ranking.search(index, asked, k=k, at_once=at_once, ahead=ahead, log=log).collect()
        assert in_order(got) == in_order(plain(docs, items, k)), (tiers, block)
        assert all(searched == proved for tier, searched, proved, _ in log if tier == len(tiers))


def test_an_item_whose_rare_terms_are_whole_in_the_first_tier_is_proved_there(spark):
    docs = [(k, "common " * 3 + f"rare{k % 40} filler{k % 7}") for k in range(2000)]
    index = ranking.TieredIndex.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), tiers=(64, 256))
    log = []
    got = ranking.search(index, spark.createDataFrame([(1, "rare3"), (2, "common filler1")], "item_id long, text string"), log=log).collect()
    assert log[0] == (0, 2, 1, 0) and log[1][1] == 1
    assert in_order(got) == in_order(plain(docs, [(1, "rare3"), (2, "common filler1")], 50))


def test_lower_tiers_are_read_of_open_blocks_only(spark):
    """Item 1's documents are in one block, where more of them than the first tier holds
    share its word; the other blocks have too little to matter."""
    docs = [(k, "target " * 5 + f"pad{k}") for k in range(30)] + [(100 + k, f"common other{k} " + "filler " * 30 + ("target" if k % 20 == 0 else "")) for k in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = ranking.TieredIndex.build(frame, tiers=(20, 60), block_postings=60)
    log, items = [], [(1, "target")]
    got = ranking.search(index, spark.createDataFrame(items, "item_id long, text string"), k=25, log=log).collect()
    assert in_order(got) == in_order(plain(docs, items, 25))
    assert index.blocks() > 20 and len(log) > 1 and 0 < log[1][3] <= 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.search(ranking.TieredIndex.build(none), items).count() == 0
    assert ranking.search(ranking.TieredIndex.build(spark.createDataFrame([(1, None), (2, "")], none.schema)), items).count() == 0
    some = ranking.TieredIndex.build(spark.createDataFrame([(1, "a b")], none.schema))
    assert ranking.search(some, items.limit(0)).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    sql = con.execute(ranking.ORACLE_SQL).fetchall()
    query = ranking.op12_tiered_search(spark, sf_dir)
    assert query.columns == [c[0] for c in con.description]
    assert in_order(query.collect()) == in_order(sql)
