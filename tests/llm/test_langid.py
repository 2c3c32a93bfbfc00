import math
import unicodedata
import zlib

import numpy as np

from robusteval.llm import langid


def plain_grams(text):
    out, last = "", ""
    for c in text:
        x = (c.lower()[0] if len(c.lower()) != 1 else c.lower()) if unicodedata.category(c)[0] == "L" else " "
        if not (x == " " and last == " "):
            out += x
        last = x
    return [out[i : i + n] for n in (1, 2, 3) for i in range(len(out) - n + 1)]


def plain_bucket(gram, buckets):
    h = ord(gram[0]) + 1
    for c in gram[1:]:
        h = (h * 0x100000001B3 + ord(c) + 1) % (1 << 64)
    return (h * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - (buckets.bit_length() - 1))


def test_hashing_and_scores_equal_plain_code():
    texts = ["Ab  c!", "", "ñandú 123 x", "7!", "Straße", "é" * 500, " a"]
    rng = np.random.default_rng(0)
    weights = np.log(rng.random((256, 3)))
    prior = np.log([0.2, 0.5, 0.3])
    names, top, whole = langid.score_texts(texts, ["a", "b", "c"], weights, prior)
    for t, name, score in zip(texts, names, np.exp(top - whole)):
        sums = sum((weights[plain_bucket(g, 256)] for g in plain_grams(t)), prior)
        n = len(plain_grams(t))
        if not any(unicodedata.category(c)[0] == "L" for c in t):
            assert name is None
            continue
        assert name == "abc"[int(sums.argmax())]
        e = [math.exp((s - sums.max()) * min(n, 40) / n) for s in sums]
        assert abs(score - 1 / sum(e)) < 1e-9
    alone = [langid.score_texts([t], ["a", "b", "c"], weights, prior) for t in texts]
    assert [x[0][0] for x in alone] == names
    assert np.allclose([x[1][0] for x in alone], top)


def test_fitting_and_prediction_equal_plain_naive_bayes(spark):
    """Counts, smoothing and priors in plain code; languages in one group or several."""
    rng = np.random.default_rng(6)
    speech = {f"l{k}": list(rng.choice(list("abcdefghijklmnop"), 6)) for k in range(7)}
    rows = []
    for i in range(260):
        lang = f"l{int(rng.integers(0, 7)) if i % 3 else 0}"
        rows.append((i, " ".join("".join(rng.choice(speech[lang], rng.integers(2, 6))) for _ in range(rng.integers(1, 6))), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    teach = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    names, buckets = sorted({lang for _, lang in teach}), 1 << 10
    sums = np.zeros((buckets, len(names)))
    for t, lang in teach:
        for g in plain_grams(t):
            sums[plain_bucket(g, buckets), names.index(lang)] += 1
    weights = np.log((sums + 0.05) / (sums + 0.05).sum(axis=0))
    prior = np.log([sum(lang == n for _, lang in teach) / len(teach) for n in names])
    for at_once in (64, 3, 1):
        got = {r.doc_id: r for r in langid.identify(df, buckets=buckets, at_once=at_once).collect()}
        for i, t, _ in rows:
            total = prior + sum(weights[plain_bucket(g, buckets)] for g in plain_grams(t))
            n = len(plain_grams(t))
            e = np.exp((total - total.max()) * min(n, 40) / n)
            assert got[i].lang_pred == names[int(total.argmax())]
            assert abs(got[i].score - 1 / e.sum()) < 1e-9


def test_more_languages_than_one_matrix_holds(spark):
    rows = [(k * 10 + j, (chr(0x4E00 + k) + " ") * 5, f"x{k:03d}") for k in range(150) for j in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, buckets=1 << 12).collect()
    assert all(r.lang_pred == f"x{r.doc_id // 10:03d}" for r in got)


def test_query_is_accurate_on_held_out_rows(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = langid.op10_naive_bayes_langid(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and any(c.isalpha() for c in docs[r.doc_id].text)]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95


def test_edge_rows(spark):
    base = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 3, "en" if i % 2 else "de", 1.0) for i in range(40)]
    odd = [(None, "the dog", "fr", 0.0), (100, None, "en", 0.0), (101, "", "en", 0.0), (102, "42 !!", "de", 0.0), (103, "the dog", None, 0.0), (103, "the dog", None, 0.0), (104, "und " * 60000, "de", 0.0)]
    df = spark.createDataFrame([*base, *odd], "doc_id long, text string, lang string, score double")
    df = df.withColumn("od`d.name", df.score)
    got = {str(r.doc_id): r for r in langid.identify(df).collect()}
    assert [got[k].lang_pred for k in ("None", "100", "101", "102", "103", "104")] == ["en", "und", "und", "und", "en", "de"]
    assert not got["None"].held_out
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(base) + 4
    assert langid.identify(df.limit(0)).count() == 0
    blank = df.withColumn("lang", df.lang.substr(99, 1)).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.identify(blank).collect()} == {"und"}
