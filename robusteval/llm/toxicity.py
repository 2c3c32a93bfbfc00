"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lowers letters, strips accents, maps homoglyphs of other scripts and
digits or signs used as letters, and turns everything else into spaces. The
lexicon holds beginnings of words and whole words with their log odds in toxic
against other labelled documents; it is learned from at most ``train_rows``
labelled rows (those whose hashed ids come first). Every term with enough evidence is
taken, none is cut off: what chance would not give is kept, and the size of the
lexicon, which the sample bounds, is checked. Exception phrases cancel the hits they cover: some are given, others are learned, pairs of words
around a hit that the labelled harmless texts hold and the toxic ones don't. The
score is a logistic function of the weight of all hits, as such and per word.

Defined results: a null text is an empty one; texts without a hit get the score
of no evidence; a null doc_id is not held out and teaches nothing; labels that
are null teach nothing; equal texts of a label count once in the choice of terms
and exceptions and each time in the scale, as does a row that is labelled twice; if
there are no labels of one kind the lexicon is empty and the score 0; rows are
independent, so repeated rows agree; whole texts are read however long; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robusteval.llm.common import hash_order_sample, id_remainder, save, spread_documents

TRAIN_ROWS = 12_000
#: More terms or phrases with evidence than this stop the learning: the sample is too large.
MOST = 500_000
#: Beginnings that a task holds before it hands their counts on.
HELD = 300_000
#: How much more frequent a term is in toxic texts, and its least evidence in nats.
RATIO, EVIDENCE = 10.0, 18.0
SHORTEST, LONGEST = 4, 16

#: Digits and signs that stand for letters (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
#: Letters of other scripts that look like Latin ones (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "з": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ь": "b",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ð": "d", "ɑ": "a", "ɡ": "g", "ꞵ": "b", "ɩ": "i",
}
#: Harmless phrases that hold words of a lexicon (fixed values).
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "oversized loser bracket", "losers bracket", "loser bracket", "idiot proof", "pathetic fallacy")
#: Combining marks and joiners vanish rather than split a word.
_VANISH = {"­", "​", "‌", "‍", "⁠", "﻿"}


class _Fold(dict):
    """Translation table filled as characters are met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        low = unicodedata.normalize("NFKD", char.lower())
        out = "".join(self.one(c) for c in low)
        self[code] = out
        return out

    @staticmethod
    def one(c: str) -> str:
        if "a" <= c <= "z":
            return c
        if c in SUBSTITUTES:
            return SUBSTITUTES[c]
        if c in HOMOGLYPHS:
            return HOMOGLYPHS[c]
        if c in _VANISH or unicodedata.category(c) in ("Mn", "Me"):
            return ""
        return c if unicodedata.category(c)[0] == "L" else " "


_table = _Fold()


def fold(text: str) -> str:
    """Folded text: words between single or more spaces, one at either end. Signs
    that stand for letters do so only before or within a word."""
    text = text.lower()
    for sign in ("!", "|"):
        if sign in text:
            text = _signs(text, sign)
    return f" {text.translate(_table)} "


def _signs(text: str, sign: str) -> str:
    """Signs without a letter on both sides become spaces."""
    parts = text.split(sign)
    out = [parts[0]]
    for before, after in zip(parts, parts[1:]):
        out.append(sign if before[-1:].isalpha() and after[:1].isalpha() else " ")
        out.append(after)
    return "".join(out)


class Lexicon:
    """Terms are beginnings of words; one that ends in a space is a whole word."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, intercept: float = -6.0, slopes: tuple[float, float] = (1.0, 0.0)):
        self.weights, self.exceptions, self.intercept, self.slopes = weights, exceptions, intercept, slopes
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term in self.weights:
                self._automaton.add_word(" " + term, (len(term) + 1, term))
            for phrase in self.exceptions:
                words = " ".join(fold(phrase).split())
                self._automaton.add_word(f" {words}", (len(words) + 1, None))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, term) of hits not covered by an exception, the longest term at
        each start."""
        return self.matches(fold(text)) if self.weights else []

    def matches(self, folded: str) -> list[tuple[int, int, str]]:
        """hits of a text that is folded already. Terms and phrases both come in order
        of their starts, so one sweep tells which hits a phrase covers."""
        found: dict[int, tuple[int, str]] = {}
        free: dict[int, int] = {}
        for last, (size, term) in self.automaton.iter(folded):
            start = last - size + 1
            if term is not None:
                found[start] = (last + 1, term)
            elif folded[last + 1 : last + 2] in (" ", ""):
                free[start] = last + 1
        out, phrases, at, upto = [], sorted(free.items()), 0, -1
        for start, (end, term) in sorted(found.items()):
            while at < len(phrases) and phrases[at][0] <= start:
                upto = max(upto, phrases[at][1])
                at += 1
            if end > upto + 1:
                out.append((start, end, term))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight of all hits, and the same per hundred words, both as logarithms. A
        term that recurs counts once and the logarithm of how often."""
        hits = self.hits(text) if text else []
        if not hits:
            return 0.0, 0.0
        times = Counter(term for _, _, term in hits)
        total = sum(self.weights[term] * (1.0 + math.log(n)) for term, n in sorted(times.items()))
        return math.log1p(total), math.log1p(100.0 * total / (len(text.split()) + 20.0))

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        a, b = self.features(text)
        x = self.intercept + self.slopes[0] * a + self.slopes[1] * b
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, x))))


def beginnings(text: str) -> Counter:
    """How often a text's folded words begin in each way; whole words end in a space."""
    out: Counter = Counter()
    for word, n in Counter(fold(text).split()).items():
        marked = word + " "
        for size in range(SHORTEST, min(len(marked), LONGEST) + 1):
            out[marked[:size]] += n
    return out


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, docs, tokens) of a partition, in parts; the empty term counts all words."""
    docs: Counter = Counter()
    tokens: Counter = Counter()

    def rows() -> pd.DataFrame:
        terms = list(docs)
        return pd.DataFrame({"term": pd.Series(terms, dtype=object), "docs": pd.Series([docs[t] for t in terms], dtype="int64"), "tokens": pd.Series([tokens[t] for t in terms], dtype="int64")})

    for pdf in batches:
        for text in pdf["text"]:
            found = beginnings(text or "")
            docs.update(found.keys())
            tokens.update(found)
            docs[""] += 1
            tokens[""] += len((text or "").split())
            if len(docs) > HELD:
                yield rows()
                docs.clear()
                tokens.clear()
    yield rows()


Counts = dict[str, tuple[int, int]]


def pick_terms(toxic: Counts, other: Counts, ratio: float = RATIO, evidence: float = EVIDENCE) -> dict[str, float]:
    """Terms and weights, from (documents, words) by term in either kind of text.

    A term must be far more frequent among the words of toxic texts, and its
    documents too unevenly divided for chance (their divergence from the share
    of toxic words, in nats). Of terms that begin alike the shortest is taken,
    but one that nearly always goes on the same way gives way to the longer one.
    """
    all_t, all_o = max(1, toxic.get("", (0, 0))[1]), max(1, other.get("", (0, 0))[1])
    share = all_t / (all_t + all_o)

    def rate(t: str) -> float:
        return math.log((toxic[t][1] + 0.5) / (all_t + 1)) - math.log((other.get(t, (0, 0))[1] + 0.5) / (all_o + 1))

    def uneven(t: str) -> float:
        n, m = toxic[t][0], other.get(t, (0, 0))[0]
        p = n / (n + m)
        return (n + m) * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0)) if p > share else 0.0

    good = {t for t in toxic if t and rate(t) >= math.log(ratio) and uneven(t) >= evidence}
    longest_child: dict[str, int] = {}
    for t in good:
        longest_child[t[:-1]] = max(longest_child.get(t[:-1], 0), toxic[t][1])
    chosen: dict[str, float] = {}
    for t in sorted(good, key=lambda t: (len(t), t)):
        if longest_child.get(t, 0) >= 0.97 * toxic[t][1]:
            continue
        if any(t[:k] in chosen for k in range(SHORTEST, len(t))):
            continue
        chosen[t] = rate(t)
    return {t: chosen[t] for t in sorted(chosen, key=lambda t: (-toxic[t][0], t))}


def evident(toxic: DataFrame, other: DataFrame, ratio: float = RATIO, evidence: float = EVIDENCE, floor: int = 5) -> tuple[Counts, Counts]:
    """The counts of the terms that have the evidence pick_terms asks for, and of all
    words: terms are weighed where they are, and only these come to the driver."""
    both = toxic.join(other.select("term", F.col("docs").alias("o_docs"), F.col("tokens").alias("o_tokens")), "term", "left").fillna(0, ["o_docs", "o_tokens"])
    all_ = {name: t.filter("term = ''").first() for name, t in (("toxic", toxic), ("other", other))}
    t, o = (max(1, r.tokens) if r else 1 for r in (all_["toxic"], all_["other"]))
    share, p = t / (t + o), F.col("docs") / (F.col("docs") + F.col("o_docs"))
    rate = F.log((F.col("tokens") + 0.5) / (t + 1)) - F.log((F.col("o_tokens") + 0.5) / (o + 1))
    divided = p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    uneven = F.when(p > share, (F.col("docs") + F.col("o_docs")) * divided).otherwise(0.0)
    near = 1e-6  # the last bits are decided where the terms are picked
    good = both.filter((F.col("term") != "") & (F.col("docs") >= floor) & (rate >= math.log(ratio) - near) & (uneven >= evidence - near))
    found = good.limit(MOST + 1).toPandas()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} terms have evidence: teach with fewer rows")
    counts = ({r.term: (int(r.docs), int(r.tokens)) for r in found.itertuples()}, {r.term: (int(r.o_docs), int(r.o_tokens)) for r in found.itertuples() if r.o_docs})
    for table, name in zip(counts, ("toxic", "other")):
        if all_[name]:
            table[""] = (all_[name].docs, all_[name].tokens)
    return counts


def phrases_at_hits(lexicon: Lexicon, text: str) -> set[str]:
    """Pairs of words around the hits of a text: the word hit with the one before and
    with the one after it."""
    folded = " ".join(["", *fold(text).split(), ""])
    out = set()
    for start, _, _ in lexicon.matches(folded):
        end = folded.index(" ", start + 1)
        before, after = folded.rfind(" ", 0, start), folded.find(" ", end + 1)
        if before >= 0:
            out.add(folded[before + 1 : end])
        if after > 0:
            out.add(folded[start + 1 : after])
    return out


def learn_exceptions(sample: DataFrame, lexicon: Lexicon, floor: int = 3) -> tuple[str, ...]:
    """Phrases around hits that at least floor harmless labelled texts hold and no
    toxic one does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(phrase, label) for text, label in zip(pdf["text"], pdf["label"]) for phrase in sorted(phrases_at_hits(lexicon, text or ""))]
            yield pd.DataFrame(rows, columns=["phrase", "label"])

    each = sample.dropDuplicates(["text", "label"]).mapInPandas(run, "phrase string, label int")
    known = each.groupBy("phrase").agg(F.sum("label").alias("toxic"), F.count("*").alias("docs")).filter((F.col("toxic") == 0) & (F.col("docs") >= floor))
    found = [r.phrase for r in known.select("phrase").limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} phrases are exceptions: teach with fewer rows")
    return tuple(sorted(found))


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Ridge logistic regression by Newton's method, of rows that count so many times;
    the last column is constant."""
    beta = np.zeros(x.shape[1])
    n = np.ones(len(x)) if times is None else times
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge * beta
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), slope)
        beta = beta + step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon and scale from the labelled rows that may teach."""
    may = F.coalesce(id_remainder(F.col(id_col), 5) != 0, F.lit(False)) & F.col(label_col).isNotNull()
    known = labels.filter(may).select(F.col(id_col).alias("own_id"), (F.col(label_col) > 0).cast("int").alias("label"))
    picked = save(hash_order_sample(known, train_rows, "own_id"), "labels")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = save(texts.join(F.broadcast(picked), F.col("id") == F.col("own_id")).select("id", "text", "label"), "labelled")
    if len(sample.select("label").distinct().collect()) < 2:
        return Lexicon({}, exceptions)

    def counts(label: int) -> DataFrame:
        rows = sample.filter(F.col("label") == label).dropDuplicates(["text"]).mapInPandas(_count_terms, "term string, docs long, tokens long")
        return save(rows.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), "counts")

    lexicon = Lexicon(pick_terms(*evident(counts(1), counts(0))), exceptions)
    if not lexicon.weights:
        return lexicon
    lexicon = Lexicon(lexicon.weights, tuple(dict.fromkeys([*exceptions, *learn_exceptions(sample, lexicon)])))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [lexicon.features(t) for t in pdf["text"]]
            yield pd.DataFrame({"a": [x for x, _ in both], "b": [x for _, x in both], "label": pdf["label"]})

    # equal rows come as one, with how many they are: an id that repeats brings no more of them
    each = sample.mapInPandas(features, "a double, b double, label int").groupBy("a", "b", "label").agg(F.count("*").alias("times"))
    data = each.toPandas().sort_values(["a", "b", "label"])
    x = np.c_[data[["a", "b"]].to_numpy(), np.ones(len(data))]
    beta = logistic(x, data["label"].to_numpy(dtype=float), data["times"].to_numpy(dtype=float))
    return Lexicon(lexicon.weights, lexicon.exceptions, float(beta[2]), (float(beta[0]), float(beta[1])))


def score_column(lexicon: Lexicon, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    lexicon = learn(docs, labels, id_col, text_col, **options)
    held = F.coalesce(id_remainder(F.col(id_col), 5) == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), score_column(lexicon, F.col(text_col).cast("string")).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spread_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
