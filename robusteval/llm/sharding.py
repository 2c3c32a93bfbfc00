"""Sharding by jump consistent hashing.

Keys are mapped to shards by Lamping and Veach's jump hash: no ring table, and a
shard appended takes its share of the rows from all others while nothing moves
between them. Rows of a shard are numbered without gaps: ids are dealt into
buckets, buckets are counted, and a row's slot is its bucket's offset plus its
place within the bucket, so no task ever sorts a whole shard. A bucket that still
is large, as rows repeat an id and its text, is cut further by a number each row
was given when it was written.

Defined results: a null text counts as empty (size 16, checksum 0); a null id is
the key 0; repeated rows share a shard and take one slot each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from robusteval.llm.common import documents, save

#: Multiplier of the generator inside jump consistent hashing (fixed value).
MULTIPLIER = np.uint64(2862933555777941757)
OVERHEAD = 16
#: A bucket this many times its planned size is cut into as many parts.
LARGE, CUTS = 4, 64


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of unsigned 64-bit keys; all keys step at once until they stop."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), dtype=np.int32)
    open_ = np.arange(len(key))
    jump = np.zeros(len(key), dtype=np.int64)
    while len(open_):
        out[open_] = jump
        with np.errstate(over="ignore"):
            key = key * MULTIPLIER + np.uint64(1)
        step = ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump = ((jump + 1) * (float(1 << 31) / step)).astype(np.int64)
        go = jump < shards
        open_, key, jump = open_[go], key[go], jump[go]
    return out


def jump_column(key: str, shards: int):
    """The shard of a long column, nulls as key 0."""

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(values.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return run(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")))


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 20_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    cut = F.pmod(F.monotonically_increasing_id(), F.lit(CUTS)).cast("int")
    base = save(base.withColumn("shard", jump_column("doc_id", shards)).withColumn("grown_shard", jump_column("doc_id", shards + 1)).withColumn("cut", cut), "shards")
    buckets = max(8, base.count() // (shards * bucket_rows))
    dealt = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = save(dealt.groupBy("shard", "bucket", "cut").agg(F.count("*").alias("n")), "buckets")
    large = counts.groupBy("shard", "bucket").agg(F.sum("n").alias("all")).filter(F.col("all") > LARGE * bucket_rows).select("shard", "bucket", F.lit(1).alias("large"))
    part = F.when(F.col("large").isNotNull(), F.col("cut")).otherwise(0)
    parts = counts.join(large, ["shard", "bucket"], "left").groupBy("shard", "bucket", part.alias("part")).agg(F.sum("n").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("shard", "bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "bucket", "part").orderBy("doc_id", "text_crc32", "size")
    rows = dealt.join(large, ["shard", "bucket"], "left").withColumn("part", part)
    numbered = rows.withColumn("place", F.row_number().over(within)).join(starts, ["shard", "bucket", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir), 40)
