"""Language identification: multinomial naive Bayes on hashed character n-grams.

Texts become code points, lower-cased, every run of non-letters one space; all
their 1- to 3-grams are hashed into buckets by arithmetic on whole arrays. The
log-probability matrix (buckets x languages) is broadcast, and a batch is scored
by gathering its rows, summing them per document and adding the logarithm of the
language's share of the documents learned from.

No language is left out: a matrix holds at most ``at_once`` of them (17 MB with
the defaults), and if there are more, each group of languages has a matrix of its
own and the best of the groups' bests is taken.

It is fitted on at most ``train_rows`` labelled documents, those whose hashed
ids come first; every document is then scored, whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a null doc_id is neither held out nor learned from; a language label that is
null teaches nothing, and if nothing can be learned all is ``und``; ties go to
the language first in code point order; rows are independent, so repeated rows
agree; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robusteval.llm.common import give_back, hash_order_sample, id_remainder, save, spread_documents

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
TRAIN_ROWS = 20_000
#: Languages of one broadcast matrix.
AT_ONCE = 64
UNKNOWN = "und"
#: Odd multipliers that spread n-grams over buckets.
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Evidence of at most so many n-grams counts for the score (not for the decision).
SCORE_GRAMS = 40.0

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point the lower-case letter it counts as, or a space."""
    global _letters
    if _letters is None:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            char = chr(c)
            if unicodedata.category(char)[0] == "L":
                low = char.lower()
                table[c] = ord(low) if len(low) == 1 else ord(low[0])
        _letters = table
    return _letters


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashed n-grams of a batch: per order the buckets and the documents they are
    of (ascending), and the number of letters of each document."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    code = letter_table()[raw]
    space = code == 32
    keep = np.empty(len(code), dtype=bool)
    keep[:1] = True
    keep[1:] = ~(space[1:] & space[:-1])
    first = starts[sizes > 0]
    keep[first] = True
    letters = np.bincount(doc[~space], minlength=len(texts))
    code, doc = code[keep].astype(np.uint64), doc[keep]
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    idx, of = [], []
    h = code + np.uint64(1)
    for n in ORDERS:
        if n > 1:
            h = h[:-1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(1) if len(h) else h
        if not len(h):
            break
        same = doc[: len(h)] == doc[n - 1 :]
        idx.append(((h * _MIX) >> shift)[same].astype(np.intp))
        of.append(doc[: len(h)][same])
    return idx, of, letters


def chunks(texts: list[str | None], most: int = 300_000) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


Model = tuple[list[str], np.ndarray, np.ndarray]


def fit(docs: DataFrame, teach: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS, at_once: int = AT_ONCE) -> list[Model]:
    """Groups of languages, in order: their names, the (buckets, languages) matrix of
    log probabilities and the log priors. One group is fetched at a time."""
    known = docs.filter(teach & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = save(hash_order_sample(known.select(F.col(id_col).alias("own_id")).distinct(), train_rows, "own_id"), "train_ids")
    sample = known.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = sample.join(F.broadcast(ids), F.col("id") == F.col("own_id"), "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, bucket, n); bucket -1 counts documents."""
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), dtype=object)
            at = 0
            for part in chunks(texts):
                own = langs[at : at + len(part)]
                at += len(part)
                idx, of, _ = grams(part, buckets)
                for lang in set(own):
                    mine = own == lang
                    if lang not in total:
                        if len(total) == AT_ONCE:
                            yield from flush(total)
                        total[lang] = np.zeros(buckets + 1, dtype=np.int64)
                    total[lang][buckets] += mine.sum()
                    for i, d in zip(idx, of):
                        total[lang] += np.bincount(i[mine[d]], minlength=buckets + 1)
        yield from flush(total)
        give_back()

    def flush(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, sums in total.items():
            hit = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(np.where(hit == buckets, -1, hit).astype(np.int32)), pa.array(sums[hit])], ["lang", "bucket", "n"])
        total.clear()

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = save(counts, "grams")
    # At most one language for each of the train_rows documents.
    taught_docs = {r.lang: r.n for r in counts.filter("bucket = -1").select("lang", "n").collect()}
    names = sorted(taught_docs)
    out = []
    for at in range(0, len(names), at_once):
        langs = names[at : at + at_once]
        table = counts.filter("bucket >= 0")
        if len(names) > at_once:
            table = table.filter(F.col("lang").between(langs[0], langs[-1]))
        place = {lang: k for k, lang in enumerate(langs)}
        sums = np.zeros((buckets, len(langs)))
        table = table.toPandas()
        sums[table["bucket"], table["lang"].map(place)] = table["n"]
        prior = np.log(np.array([taught_docs[lang] for lang in langs]) / sum(taught_docs.values()))
        out.append((langs, np.log((sums + 0.05) / (sums + 0.05).sum(axis=0, keepdims=True)), prior))
    return out


def score_texts(texts: list[str], langs: list[str], weights: np.ndarray, prior: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """For each text the likeliest of some languages (none if it has no letter), its
    log probability and the logarithm of all their probabilities' sum, both scaled
    to at most SCORE_GRAMS n-grams' evidence."""
    idx, of, letters = grams(texts, len(weights))
    total = np.repeat(prior[None, :], len(texts), axis=0)
    n = np.zeros(len(texts))
    for i, d in zip(idx, of):
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.empty(0, dtype=np.intp)
        if len(first):
            total[d[first]] += np.add.reduceat(weights[i], first, axis=0)
            n += np.bincount(d, minlength=len(texts))
    best = total.argmax(axis=1)
    total *= (np.minimum(n, SCORE_GRAMS) / np.maximum(n, 1.0))[:, None]
    top = total.max(axis=1)
    whole = top + np.log(np.exp(total - top[:, None]).sum(axis=1))
    return [langs[b] if k else None for b, k in zip(best.tolist(), letters.tolist())], top, whole


def predictor(spark: SparkSession, model: Model):
    """A pandas UDF text -> (lang, top, whole) of a group, with its broadcast matrix."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, top double, whole double")
    def run(texts: pd.Series) -> pd.DataFrame:
        parts = [score_texts(part, *shared.value) for part in chunks(texts.tolist())]
        names = [name for part in parts for name in part[0]]
        top, whole = (np.concatenate([np.zeros(0), *[part[k] for part in parts]]) for k in (1, 2))
        return pd.DataFrame({"lang": pd.Series(names, dtype=object), "top": top, "whole": whole})

    return run


def prediction(spark: SparkSession, models: list[Model], text: Column) -> Column:
    """struct(lang_pred, score) of a text, over all groups of languages."""
    if not models:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = F.array(*[predictor(spark, m)(text) for m in models])

    def best(all_: Column) -> Column:
        first = F.reduce(all_, all_[0], lambda a, x: F.when(x["top"] > a["top"], x).otherwise(a))
        whole = F.reduce(all_, F.lit(0.0), lambda a, x: a + F.exp(x["whole"] - first["top"]))
        known = first["lang"].isNotNull()
        return F.struct(F.when(known, first["lang"]).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, 1 / whole).otherwise(0.0).alias("score"))

    return F.get(F.transform(F.array(found), best), F.lit(0))


def taught(id_col: str = "doc_id") -> Column:
    """Which rows may teach: the checksum of their id leaves another remainder than 2."""
    return F.coalesce(id_remainder(F.col(id_col), 4) != 2, F.lit(False))


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs."""
    models = fit(docs, taught(id_col), text_col, lang_col, id_col, **options)
    held = F.coalesce(id_remainder(F.col(id_col), 4) == 2, F.lit(False))
    found = prediction(docs.sparkSession, models, F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), found.alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose language can't be told."""
    models = fit(docs, taught(id_col), text_col, lang_col, id_col, **options)
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    held = docs.toDF(*names.values())
    found = prediction(docs.sparkSession, models, F.col(names[text_col]).cast("string"))
    return held.withColumn("found", found).filter(F.col("found")["lang_pred"] != UNKNOWN).drop("found").toDF(*docs.columns)


def op10_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spread_documents(spark, sf_dir))
