import hashlib
import re

import duckdb
import pytest

from robusteval.llm import infilling

MATCH = {
    "lines": r"[^\n]*\n|[^\n]+",
    "words": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*",
    "characters": r"[\s\S]",
}


def one(doc_id, text, grammar="lines", percent=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(MATCH[grammar], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check(rows, texts, **how):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for i, t in texts:
        n, form, pre, mid, out = one(i, t, **how)
        expected.append((i, n, form, pre, mid, sha(out), sha(t or "")))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)


EDGES = [
    (None, None), (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "a"), (6, "a\n"), (7, "a\nb"), (8, "\na\r\nb c\x85d\n\n"),
    (9, "x <P> y\nz"), (10, "<S>"), (11, "<M"), (12, "<\nP>\n<"), (13, "\U0001f600\U0001f600\n\U0001f601 é ﻿"), (13, "\U0001f600\U0001f600\n\U0001f601 é ﻿"),
    (14, "line\n" * 50_000), (15, "z" * 300_000), (-16, " \t\n \x0b\n\x00\n"), (2**62, ">\nS><\n$1\\E\\Q\n"),
]


@pytest.mark.parametrize("grammar", ["lines", "words", "characters"])
def test_units_and_parts_of_odd_texts(spark, grammar):
    texts = [(i, t) for i, t in EDGES if grammar == "lines" or len(t or "") < 1000]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id long, text string, form string, n int")
    check(infilling.digests(infilling.fill_in_middle(docs, grammar)).collect(), texts, grammar=grammar)
    assert infilling.fill_in_middle(docs.limit(0), grammar).count() == 0


def test_rates_seeds_and_outputs(spark):
    texts = [(k, f"a{k}\nb\n\nc d\n{k}") for k in range(300)]
    docs = spark.createDataFrame(texts, "id long, body string")
    rows = infilling.fill_in_middle(docs, "words", percent=60, spm_percent=20, seed=3, id_col="id", text_col="body").collect()
    for r in rows:
        assert (r.n, r.form, r.output) == tuple(one(r.doc_id, dict(texts)[r.doc_id], "words", 60, 20, 3)[k] for k in (0, 1, 4))
        assert r.form == "plain" or r.prefix + r.middle + r.suffix == r.text
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("grammar", list(infilling.GRAMMARS))
def test_every_grammar_keeps_every_character(spark, grammar):
    texts = [(i, t) for i, t in EDGES if len(t or "") < 1000] + [(100, "One. Two! Three?\n\nNew 12ab éè \U0001f600.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = infilling.digests(infilling.fill_in_middle(docs, grammar)).collect()
    assert sorted(r.restored_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts)


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    sql = sorted(con.execute(infilling.ORACLE_SQL).fetchall())
    query = infilling.op11_lookaround_infilling(spark, sf_dir)
    assert query.columns == [c[0] for c in con.description]
    assert sorted(map(tuple, query.collect())) == sql
