import re

import numpy as np
import pytest

from robusteval.llm import quality


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines, seen, dup, with_word = text.split("\n"), set(), 0, 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            with_word += 1
            dup += line in seen
            seen.add(line)
    mark = [False] * len(words)
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in where.values():
        if len(at) > 1:
            for i in at:
                mark[i : i + 5] = [True] * 5
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, sum(mark), with_word


@pytest.mark.parametrize("text", ["", None, " \n\t", "a", "é ß\x0bx\x85y z", "a b c d e a b c d e", "a a a a a a a", "#x|<b>&&\n#x|<b>&&\n\n \n", "l\nl\nl \nl", "p q r s t u p q r s t x p q r s t"])
def test_counts(text):
    assert quality.text_counts(text.encode() if text is not None else None) == brute(text)


def test_query_counts_and_verdicts(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality.op1_mcd_quality(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, dup, rep, _ = brute(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean([r.kept for r in good]) > 0.97
    assert np.mean([r.kept for r in bad]) < 0.2


FLOOR = np.diag(quality.FLOORS)


def brute_floor(cov):
    half = np.linalg.inv(FLOOR)
    w, v = np.linalg.eigh(half @ cov @ half)
    return FLOOR @ v @ np.diag(np.maximum(w, 1)) @ v.T @ FLOOR


def brute_estimate(x):
    """Concentration steps over rows in memory: centre and covariance."""

    def step(m, c):
        d = x - m
        d2 = np.maximum(np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d), 0)
        bins = np.clip(np.floor(np.log2(d2 + 1e-12) * 8), quality.MIN_BIN, quality.MAX_BIN)
        near = x[bins <= np.sort(bins)[int(np.ceil(quality.SHARE * len(x))) - 1]]
        return near.mean(axis=0), np.cov(near.T, bias=True).reshape(4, 4), len(near) / len(x)

    ordered = np.sort(x, axis=0)
    low, middle, high = (ordered[max(0, int(np.ceil(q * len(x))) - 1)] for q in (0.25, 0.5, 0.75))
    best = None
    for m, c in [(middle, np.diag(((high - low) / 1.349) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True).reshape(4, 4)), (middle, np.zeros((4, 4)))]:
        c = brute_floor(c)
        for _ in range(quality.STEPS - 1):
            m, c, _ = step(m, c)
            c = brute_floor(c)
        if best is None or np.linalg.slogdet(c)[1] < best[0] - 1e-9:
            best = (np.linalg.slogdet(c)[1], m, c)
    m, c, share = step(*best[1:])
    return m, brute_floor(max(1.0, quality.consistency(share)) * c)


def brute_distances(rows):
    """rows: (lang, source, x) of rows that pass the base rule, to squared distances."""
    x = np.array([r[2] for r in rows])
    out = []
    known = {}
    for lang, source, at in rows:
        if (lang, source) not in known:
            mean = cov = None
            for of in ([True] * len(rows), [r[0] == lang for r in rows], [r[:2] == (lang, source) for r in rows]):
                part = x[np.array(of)]
                m, c = brute_estimate(part)
                if mean is None:
                    mean, cov = m, c
                    continue
                own, w, apart = len(part) / (len(part) + 60), 1 / (1 + (18 / len(part)) ** 3), m - mean
                cov = own * c + (1 - own) * cov + w * (1 - w) * apart[:, None] * apart[None, :]
                mean = mean + w * apart
            known[lang, source] = mean, np.linalg.inv(cov)
        m, p = known[lang, source]
        out.append((at - m) @ p @ (at - m))
    return out


def vector(n, chars, symbols, dup, rep, lines):
    return [np.log((chars + 100) / (n + 20)), np.log1p(symbols / (n + 5)), dup / (lines + 4), rep / (n + 20)]


def test_whole_verdict_equals_brute_force(spark, sf_dir):
    """Counts, every estimate and the verdict, against rows in memory."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = {k: brute(d.text) for k, d in docs.items()}
    fit = [k for k, (n, _, _, _, rep, _) in counts.items() if n >= 10 and 100 * rep <= 20 * n]
    want = dict(zip(fit, brute_distances([(docs[k].lang, docs[k].source, np.array(vector(*counts[k]))) for k in fit])))
    got = {r.doc_id: r for r in quality.op1_mcd_quality(spark, sf_dir).collect()}
    for k in fit:
        assert got[k].distance == pytest.approx(want[k], rel=1e-6, abs=1e-9)
        assert got[k].kept == (want[k] <= quality.CUTOFF)


def test_few_rows_do_not_judge_themselves(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    clean = lambda: " ".join(word() for _ in range(60))
    junk = [" ".join(word() + "###$$" for _ in range(60)) for _ in range(3)]
    docs = [(k, clean(), "en", "big") for k in range(300)] + [(1000 + k, t, "en", "tiny") for k, t in enumerate(junk)] + [(2000 + k, t, "en", "big") for k, t in enumerate(junk)] + [(3000 + k, t, "new", "alone") for k, t in enumerate(junk)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k].kept for k in range(300))
    for k in range(3):
        for at in (1000, 2000, 3000):
            assert not got[at + k].kept and got[at + k].distance > 50
    none = quality.quality(spark.createDataFrame([(1, "a", "en", "s")], "doc_id long, text string, lang string, source string")).first()
    assert none.distance is None and not none.kept


def test_binned_estimate_equals_the_plain_one():
    """The binned sums of a step give the mean and covariance of the nearest rows."""
    import pandas as pd

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)) * [0.1, 0.2, 0.1, 0.3]
    x[:60] += 5
    centre, p = np.median(x, axis=0), np.diag(1 / np.square(quality.FLOORS))
    x[100:] *= [2, 1, 4, 1]
    d2 = np.einsum("ni,ij,nj->n", x - centre, p, x - centre)
    bins = np.clip(np.floor(np.log2(d2 + 1e-12) * 8), quality.MIN_BIN, quality.MAX_BIN).astype(int)
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    table = pd.DataFrame([{"gid": 1, "start": 0, "bin": b, "n": (bins == b).sum(), **{f"s{k}": x[bins == b, k].sum() for k in range(4)}, **{f"q{k}": (x[bins == b, i] * x[bins == b, j]).sum() for k, (i, j) in enumerate(pairs)}} for b in np.unique(bins)])
    out = quality._estimate(0.75, False)(table).iloc[0]
    cut = np.sort(bins)[int(np.ceil(0.75 * 400)) - 1]
    near = x[bins <= cut]
    cov = brute_floor(np.cov(near.T, bias=True))
    assert np.allclose(out.m, near.mean(axis=0))
    assert np.allclose(out.p, [np.linalg.inv(cov)[i, j] for i, j in pairs])
    assert not (bins[:60] <= cut).any()


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    docs = [(i, " ".join(word() for _ in range(60)), "en", "s") for i in range(150)]
    odd = [(None, None, None, None), (900, "", "en", "s"), (901, " ".join(word() + "###" for _ in range(60)), "en", "s"), (902, " ".join(word() for _ in range(60)), None, "s"), (903, " ".join(word() for _ in range(60)), "xx", None), (903, "z " * 70000, "en", "s"), (904, docs[0][1], "en", "s"), (904, docs[0][1], "en", "s")]
    df = spark.createDataFrame([(*d, True) for d in [*docs, *odd]], "doc_id long, text string, lang string, source string, kept boolean")
    got = {}
    for r in quality.quality(df).collect():
        got.setdefault(str(r.doc_id), []).append((r.base_failed, r.kept))
    assert sum(k for i in range(150) for _, k in got[str(i)]) == 150
    assert got["None"] == got["900"] == [(True, False)]
    assert got["901"] == [(False, False)]
    assert got["902"] == [(False, True)] and got["904"] == [(False, True)] * 2
    assert sorted(got["903"]) == [(False, True), (True, False)]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 154
    assert quality.quality(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10, 30, 100, 300])
def test_clean_sources_with_a_centre_of_their_own_are_kept(spark, n):
    """Longer words with signs in one source of a language: its ordinary rows; and junk
    among the language's rows goes all the same."""
    rng = np.random.default_rng(n)
    word = lambda a, b: "".join(rng.choice(list("abcdefghij"), rng.integers(a, b)))
    clean = [(k, " ".join(word(3, 8) for _ in range(60)), "en", "prose") for k in range(1500)]
    other = [(5000 + k, " ".join(word(9, 16) + (" & " if rng.random() < 0.2 else "") for _ in range(60)), "en", "own") for k in range(n)]
    junk = [(9000 + k, " ".join(word(3, 8) + "###$$" for _ in range(60)), "en", "prose") for k in range(20)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(clean + other + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[k] for k, *_ in clean) >= 1495
    assert sum(got[k] for k, *_ in other) >= n - max(1, n // 100)
    assert not any(got[k] for k, *_ in junk)
