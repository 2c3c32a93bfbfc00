import zlib

import numpy as np

from robusteval.llm import toxicity


def test_folding():
    assert toxicity.fold("1D10T! l0ser| сlоwn").split() == ["idiot", "loser", "clown"]
    assert toxicity.fold("É́ß tr​ash pa!n").split() == ["eß", "trash", "pain"]
    assert toxicity.fold("") == "  "


def brute_hits(text, weights, exceptions):
    folded = toxicity.fold(text)
    out = {}
    for s in range(len(folded)):
        for term in weights:
            if folded.startswith(" " + term, s):
                e = s + len(term) + 1
                if s not in out or e > out[s][0]:
                    out[s] = (e, term)
    free = []
    for phrase in exceptions:
        p = " " + " ".join(toxicity.fold(phrase).split())
        at = folded.find(p)
        while at >= 0:
            if folded[at + len(p)] == " ":
                free.append((at, at + len(p)))
            at = folded.find(p, at + 1)
    return [(s, e, t) for s, (e, t) in sorted(out.items()) if not any(a <= s and e <= b + 1 for a, b in free)]


def test_matching_equals_a_scan_of_all_terms():
    weights = {"trash ": 3.0, "clow": 2.0, "clown ": 4.0, "stup": 1.0}
    exceptions = ("clown fish", "trash can")
    lexicon = toxicity.Lexicon(weights, exceptions)
    for text in ("trash trash can TRASHY clown clownish clown fish clown fishes stup1d", "", "trash", "x clown", "clown clown fish"):
        assert lexicon.hits(text) == brute_hits(text, weights, exceptions)
    assert len(lexicon.hits("trash trash can")) == 1
    rng = np.random.default_rng(4)
    for _ in range(200):
        text = " ".join(rng.choice(["trash", "can", "clown", "fish", "stupid", "x", "clownfish"], rng.integers(1, 30)))
        assert lexicon.hits(text) == brute_hits(text, weights, exceptions)
    assert lexicon.score("") == lexicon.score(None) == lexicon.score("calm words")
    assert lexicon.score("you clown") > lexicon.score("calm")


def test_terms_of_one_weight_are_different_terms():
    same = toxicity.Lexicon({"vile": 2.0, "mean": 2.0}, ())
    near = toxicity.Lexicon({"vile": 2.0, "mean": 2.0000001}, ())
    assert abs(same.features("vile mean")[0] - near.features("vile mean")[0]) < 1e-6
    assert same.features("vile vile")[0] < same.features("vile mean")[0]


def test_given_and_learned_exceptions_cancel_hits(spark):
    """Half of the harmless texts hold a toxic word in a harmless phrase."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = []
    for i in range(600):
        own = [word() for _ in range(20)]
        if i % 4 == 0:
            own.insert(5, "zounds")
        elif i % 40 == 1:
            own[5:5] = ["zounds", "museum"]
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    lexicon = toxicity.learn(df, labels)
    assert "zounds museum" in lexicon.exceptions and "trash can" in lexicon.exceptions
    assert lexicon.score("a zounds museum here") < 0.5 < lexicon.score("a zounds here")
    given = toxicity.Lexicon({"trash ": 5.0}, toxicity.EXCEPTIONS, -3.0)
    assert given.hits("the tr4sh c@n is full") == [] and len(given.hits("the tr4sh is full")) == 1
    hits = brute_hits("zounds museum zounds", lexicon.weights, lexicon.exceptions)
    assert lexicon.hits("zounds museum zounds") == hits and len(hits) == 1


def test_learned_weights_and_scores_equal_brute_force(spark):
    """Log odds of the terms over whole labelled texts, and the score from hits."""
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    rows = [(i, " ".join([*rng.choice(vocabulary, 25), *(["vileword"] * (1 + i % 3) if i % 5 == 0 else [])])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int")
    lexicon = toxicity.learn(df, labels)
    taught = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    words = {k: [w for i, t in taught if (i % 5 == 0) == k for w in t.split()] for k in (True, False)}
    (term,) = lexicon.weights
    assert "vileword ".startswith(term)
    count = {k: sum((w + " ").startswith(term) for w in words[k]) for k in words}
    odds = np.log((count[True] + 0.5) / (len(words[True]) + 1)) - np.log((count[False] + 0.5) / (len(words[False]) + 1))
    assert abs(lexicon.weights[term] - odds) < 1e-9
    got = {r.doc_id: r.score for r in toxicity.score_documents(df, labels).collect()}
    for i, t in rows:
        n = t.split().count("vileword")
        total = odds * (1 + np.log(n)) if n else 0.0
        x = lexicon.intercept + lexicon.slopes[0] * np.log1p(total) + lexicon.slopes[1] * np.log1p(100 * total / (len(t.split()) + 20))
        assert abs(got[i] - 1 / (1 + np.exp(-x))) < 1e-9


def test_query_finds_toxic_rows_it_never_saw(spark, sf_dir):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = toxicity.op2_lexicon_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.9


def test_edge_rows(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    docs = [(i, " ".join(word() for _ in range(20)) + (" vileword" if i % 4 == 0 else ""), "en") for i in range(200)]
    odd = [(None, "v1leword", "x"), (900, None, "x"), (901, "", None), (902, "calm", "x"), (902, "calm", "x"), (903, ("calm " * 19 + "vílеword ") * 3000, "x"), (904, "vileword", "x")]
    df = spark.createDataFrame([(*d, 0.5) for d in [*docs, *odd]], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 7) for i in range(200)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    got = {str(r.doc_id): r.predicted for r in toxicity.score_documents(df, labels).collect()}
    assert [got[k] for k in ("None", "900", "901", "902", "903", "904")] == [1, 0, 0, 0, 1, 1]
    assert toxicity.score_documents(df.limit(0), labels).count() == 0
    none = toxicity.score_documents(df, labels.limit(0)).collect()
    assert len(none) == 207 and {r.score for r in none} == {0.0}
