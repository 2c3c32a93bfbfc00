"""The corpus pipeline: language, quality, near-duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of docs. ``run`` writes each stage's result as Parquet
in the folder the machines share and hands the next stage what it reads back,
so a stage that loses executors repeats its own work only; what a stage made
besides its result, and the result before it, is deleted.

For every stage: whole texts are read, however long; other columns, whatever
their names, pass through (the last stage returns its own); rows are judged alike
however often they repeat; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from robusteval.llm import bpe, langid, mixing, quality, simhash
from robusteval.llm.common import discard, documents, last_saved, save, scratch
from robusteval.session import ship_package, small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null texts and texts without a letter go, and all if no row teaches a language;
    equal odds go to the language first by code point; rows with a null id stay or
    go by their text; null languages teach nothing.
    """
    ship_package(spark)
    small_batches(spark)
    return langid.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the outlier rule rejects.

    Null, empty and very short texts fail the base rule and go; null languages and
    sources are groups like any other; equal distances are judged alike.
    """
    ship_package(spark)
    small_batches(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Null and wordless texts are one group; of rows that repeat an id one stays; rows
    with a null id all stay, as nothing names them.
    """
    ship_package(spark)
    small_batches(spark)
    return simhash.keep_representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so rows repeat.

    Texts without a word have size 0 and come at their source's rate; a null source
    is a source of its own; null and repeated ids are told apart by their texts.
    """
    return mixing.take_copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256, exact) of every document.

    A null text is an empty one: no tokens, the digests of nothing. A null id stays
    null; each copy of a row is a row.
    """
    ship_package(spark)
    small_batches(spark)
    return bpe.round_trip(docs, bpe.default_path(), keep_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("encode", encode),
]

#: Fingerprints, robust estimates and merges are beyond SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = save(stage(spark, docs, sf_dir), name)
            kept.append(last_saved())
        if before is not None:
            discard(spark, before)
        before = kept[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
