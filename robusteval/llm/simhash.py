"""SimHash near-duplicates, with candidates pruned by the pigeonring principle.

A 64-bit fingerprint is cut into a ring of eight byte segments. If two differ
in t <= 3 bits, some segment starts a chain whose first l segments differ in at
most floor(3 l / 8) bits for every l = 1..8 (budgets 0 0 1 1 1 2 2 3). So its
first two segments are equal and at least two of the next three are: each
(start, dropped segment) gives a 32-bit key, 24 in all, and only fingerprints
that share a key are compared, first by the chain, last by all 64 bits.

Equal fingerprints are collapsed before keys are made. A key shared by more
than ``block`` fingerprints is dealt into slices, every pair of slices a unit of
its own, so no task holds a whole group. Units return a spanning forest (fewer
rows than they read), never their pairs.

Defined results: a null or wordless text has fingerprint zero and links like
any other; texts of one or two words hash as one shingle; repeated rows get the
same answer; a null doc_id neither names nor joins a component (its row takes
its fingerprint's component, null if no row there has an id); other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robusteval.llm.common import components, give_back, local_roots, save, spread_documents

SEGMENTS = 8
MAX_BITS = 3
_POP8 = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_BITS = np.array([[v >> k & 1 for k in range(8)] for v in range(256)], dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text over word shingles, A-Z lowered."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], dtype="<u8")
    ones = np.empty(64, dtype=np.int64)
    for k, column in enumerate(h.view(np.uint8).reshape(-1, 8).T):
        ones[8 * k : 8 * k + 8] = np.bincount(column, minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, text_hash, fp): one row per document, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = [fingerprint(t.as_py(), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["id", "text_hash", "fp"])
        give_back()

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "id long, text_hash long, fp long")


def ring_keys(fp: str) -> list:
    """The 24 blocking keys of a fingerprint column, as Spark expressions."""
    byte = [F.shiftrightunsigned(F.col(fp), 8 * i).bitwiseAND(F.lit(255)) for i in range(SEGMENTS)]
    keys = []
    for start in range(SEGMENTS):
        chain = [byte[(start + i) % SEGMENTS] for i in range(5)]
        for drop in range(3):
            used = chain[:2] + [x for i, x in enumerate(chain[2:]) if i != drop]
            key = F.lit(3 * start + drop).cast("long")
            for x in used:
                key = F.shiftleft(key, 8).bitwiseOR(x)
            keys.append(key)
    return keys


def chain_viable(x: np.ndarray, start: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Which differences x (xor, uint64) keep to all chain budgets from their start."""
    alive = np.arange(len(x))
    spent = np.zeros(len(x), dtype=np.uint8)
    for length in range(1, SEGMENTS + 1):
        shift = (8 * ((start[alive] + length - 1) % SEGMENTS)).astype(np.uint64)
        spent = spent + _POP8[(x[alive] >> shift & np.uint64(255)).astype(np.intp)]
        ok = spent <= length * max_bits // SEGMENTS
        alive, spent = alive[ok], spent[ok]
    out = np.zeros(len(x), dtype=bool)
    out[alive] = True
    return out


def _unit_links(key: np.ndarray, part: np.ndarray, fp: np.ndarray, cross: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs within units; rows of a unit are adjacent. In a unit of
    two slices (cross) only pairs between them are compared: others are theirs."""
    n, found_l, found_r = len(key), [], []
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    length = np.diff(np.r_[first, n])
    last = np.repeat(first + length, length)
    start = (key >> 32) // 3
    single = (part >> 20) == (part & 0xFFFFF)
    open_ = np.arange(n)
    for gap in range(1, int(length.max(initial=1))):
        open_ = open_[open_ + gap < last[open_]]
        left = open_[single[open_] | (cross[open_] != cross[open_ + gap])]
        right = left + gap
        ok = chain_viable(fp[left] ^ fp[right], start[left], max_bits)
        found_l.append(left[ok])
        found_r.append(right[ok])
    cat = lambda x: np.concatenate(x) if x else np.empty(0, dtype=np.intp)
    return cat(found_l), cat(found_r)


def _forest(max_bits: int, enough: int = 65536):
    """mapInPandas function over rows sorted by unit: edges (a, b) of a spanning forest."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        left, right = _unit_links(pdf["key"].to_numpy(), pdf["part"].to_numpy(), fp, pdf["slice"].to_numpy(), max_bits)
        ids = pdf["id"].to_numpy()
        root = local_roots(len(ids), left, right)
        linked = np.flatnonzero(root != np.arange(len(ids)))
        pairs = pd.DataFrame({"a": ids[root[linked]], "b": ids[linked]})
        return pairs.drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) >= enough:
                same = (held["key"] == held["key"].iat[-1]) & (held["part"] == held["part"].iat[-1])
                done, held = held[~same], held[same].reset_index(drop=True)
                if len(done):
                    yield solve(done.reset_index(drop=True))
        if held is not None and len(held):
            yield solve(held)

    return run


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = 512) -> DataFrame:
    """Edges (a, b) that connect exactly what fingerprints (id, fp) within
    max_bits connect; fps must hold each fingerprint once."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    keyed = fps.select("id", "fp", F.explode(F.array(*ring_keys("fp"))).alias("key"))
    hot = keyed.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("slices"))
    sliced = keyed.join(hot, "key", "left").select("key", "id", "fp", F.coalesce("slices", F.lit(1)).alias("slices"))
    mine = F.pmod(F.xxhash64("id"), F.col("slices").cast("long")).cast("int")
    sliced = sliced.withColumn("slice", mine)
    dealt = sliced.select("key", "id", "fp", "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    part = F.shiftleft(F.least("slice", "other").cast("long"), 20).bitwiseOR(F.greatest("slice", "other").cast("long"))
    units = dealt.select("key", "id", "fp", "slice", part.alias("part")).repartition("key", "part").sortWithinPartitions("key", "part", "id")
    return units.mapInPandas(_forest(max_bits), "a long, b long")


def grouped(docs: DataFrame, id_col: str, text_col: str, max_bits: int, block: int) -> DataFrame:
    """(id, text_hash, fp, component_id) for every row of docs. Fingerprints link, not
    ids: rows without an id connect like any others, and a component is named by the
    smallest id in it."""
    marks = save(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = save(marks.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    found = components(near_links(distinct.select("fp", F.col("fp").alias("id")), max_bits, block))
    of = save(distinct.join(found.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component")), "members")
    names = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return marks.join(of.join(names, "component").select("fp", "component_id"), "fp", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, block: int = 512) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    rows = grouped(docs, id_col, text_col, max_bits, block)
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Up to so many rows to drop are broadcast (a hash table of some 27 MB); with more,
#: documents and the rows to keep are joined by a shuffle.
FEW = 250_000


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, block: int = 512, few: int = FEW) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest id. Of rows
    that repeat this id one with a text of the group stays. Rows without an id all
    stay: nothing names them as copies.

    Which rows stay is decided on ids and hashes of texts; documents are joined
    with the few columns of that, and only rows that repeat id and text are moved."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    held, ident, text = docs.toDF(*names.values()), names[id_col], names[text_col]
    found = grouped(held, ident, text, max_bits, block).filter("id is not null")
    stands = F.max(F.col("id") == F.col("component_id")).alias("stands")
    each = save(found.groupBy("id", "text_hash").agg(F.count("*").alias("times"), stands), "decided")
    keep = save(each.filter("stands").groupBy("id").agg(F.min(F.struct("text_hash", "times")).alias("own")).select("id", "own.*"), "kept")
    gone = save(each.select("id", "text_hash").join(keep, ["id", "text_hash"], "left_anti"), "gone")
    again = keep.filter("times > 1")

    def among(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        same = (F.col(ident).cast("long") == other["id"]) & (F.xxhash64(F.col(text).cast("string")) == other["text_hash"])
        return rows.join(other, same, how)

    if gone.count() <= few:
        out = among(held, F.broadcast(gone), "left_anti")
    else:
        out = among(held, keep, "left_semi").unionByName(held.filter(F.col(ident).isNull()))
    if not again.isEmpty():
        out = among(out, again, "left_anti").unionByName(among(held, again, "left_semi").dropDuplicates([ident]))
    return out.toDF(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread_documents(spark, sf_dir))
