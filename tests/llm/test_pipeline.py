from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from robusteval.llm import bpe, mixing
from tests.llm.test_mixing import brute_targets, words
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_simhash import brute_components, brute_fp


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, columns = docs, docs.columns
    rows = [r.asDict() for r in docs.collect()]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf_dir)
        if name != "encode":
            assert at.columns == columns
        out[name] = [r.asDict() for r in at.collect()]
        at = spark.createDataFrame(out[name], docs.schema) if name != "encode" else at
    same = lambda a, b: Counter(map(str, a)) == Counter(map(str, b))
    assert same(out["language_id"], [r for r in rows if any(c.isalpha() for c in r["text"])])
    for r in out["quality_rules"]:
        n, _, _, _, rep, _ = brute_counts(r["text"])
        assert n >= 10 and 100 * rep <= 20 * n
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in out["quality_rules"]}
    good = [r for r in out["language_id"] if labels.get(r["doc_id"]) == 1 and brute_counts(r["text"])[0] >= 10 and 100 * brute_counts(r["text"])[4] <= 20 * brute_counts(r["text"])[0]]
    assert all(r["doc_id"] in kept for r in good)
    groups = brute_components([(r["doc_id"], brute_fp(r["text"])) for r in out["quality_rules"]])
    assert same(out["near_duplicates"], [r for r in out["quality_rules"] if groups[r["doc_id"]] == r["doc_id"]])
    sizes = Counter()
    for r in out["near_duplicates"]:
        sizes[r["source"]] += words(r["text"])
    target, taken = brute_targets(dict(sizes)), Counter()
    for r in out["source_mix"]:
        taken[r["source"]] += words(r["text"])
    largest = max(words(r["text"]) for r in out["near_duplicates"])
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes)
    assert max(Counter(r["doc_id"] for r in out["source_mix"]).values()) <= 2
    library = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert len(out["encode"]) == len(out["source_mix"])
    for r in out["encode"]:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["exact"]


def test_run_equals_its_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact", "ids"]
    first = Counter(map(str, got.select("doc_id", "ids_sha256").collect()))
    assert first == Counter(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()))
    assert np.mean(list(first.values())) >= 1


def test_stages_take_odd_tables(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, "some words of a clean text that nobody rejects here today", "en", None, 3, 3), (2, "some words of a clean text that nobody rejects here today", "en", None, 3, 3)],
        "doc_id long, text string, lang string, source string, n_chars long, kept int",
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0
    one = docs
    for _, stage in corpus_pipeline.STAGES:
        one = stage(spark, one, "")
    assert one.count() in (1, 2)
    assert mixing.take_copies(docs).count() >= 1
