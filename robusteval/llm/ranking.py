"""Ranked lexical search over a tiered index.

The index is a table of postings by blocks of documents: a row is a term of a block in
one tier, with the documents' places in the block and the term's impacts there, from
the highest down. The first tier holds the highest impacts of every term of a block,
the next the following ones, the last the rest; so a term of few documents is whole
in the first tier. Each row carries the residual bound of its term: the highest impact
in the tiers below, 0 if there is none. Tiers lie in folders of their own.

A search reads the first tier. What its items lack is bounded: a document can gain at
most the weighted residuals of the terms it was not found under. An item is proved
exact if no document that may gain anything can reach its last rank; all other items
fall through to the next tier, with the tiers above, in the blocks that hold such a
document, and at the last tier there are no residuals left. Blocks are searched apart from each other, and only each one's best
documents of an item and its highest open bound leave it, so neither a common
term nor a large corpus gathers anywhere. What travels to the tasks is the items'
terms, dealt into blocks of items of bounded size.

Scores are whole numbers: weight * impact, summed over an item's distinct terms.

Defined results: a null or empty text, or one without a term, has none and is never
found, and does not count among the documents; an item without a term or without a
document finds nothing; equal scores rank by ascending id, null ids last, and rows that
repeat an id are documents of their own; every row of the items is an item, ids
repeated or null; very long texts are counted whole; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from robusteval.llm.common import drop, give_back, save, scratch_path, spread_documents

#: Terms: runs of ASCII letters, digits and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on bytes: separators become spaces, A-Z small letters.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
#: A term's postings of a block in the first tier, and in the first two.
TIERS = (32, 256)
#: Postings of a block, and pairs of item and term that travel to the tasks at once.
BLOCK_POSTINGS, ITEM_TERMS = 1_000_000, 1_000_000
#: Blocks that are searched first for a floor, if there are many more.
AHEAD = 128


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, total): documents that hold each term; the row without a term counts
    the documents that have one, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[bytes] = Counter()
        n = total = 0

        def rows() -> pa.RecordBatch:
            terms = pa.array([None, *df], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([terms, pa.array([n, *df.values()], pa.int64()), pa.array([total] + [0] * len(df), pa.int64())], ["term", "df", "total"])

        for batch in batches:
            for text in batch.column(0):
                found = terms_of(text.as_py())
                n, total = n + bool(found), total + len(found)
                df.update(set(found))
                if len(df) > 500_000:
                    yield rows()
                    df.clear()
                    n = total = 0
        yield rows()
        give_back()

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term string, df long, total long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, by its weight: tf times among n terms."""
    m = 100 - 50 + (50 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def postings(docs: DataFrame, count: int, total: int, id_col: str = "doc_id", text_col: str = "text", block_postings: int = BLOCK_POSTINGS, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """(block, tier, term, places, impacts, residual, ids): the index. A block's row
    without a term, in the first tier, has its documents' ids by place."""

    def block_rows(name: str, ids: list, code: dict[bytes, int], made: list[tuple[list[int], list[int], int]]) -> Iterator[pa.RecordBatch]:
        size = [len(c) for c, _, _ in made]
        term = np.fromiter((c for codes, _, _ in made for c in codes), dtype=np.int64, count=sum(size))
        tf = np.fromiter((f for _, fs, _ in made for f in fs), dtype=np.int64, count=sum(size))
        place = np.repeat(np.arange(len(made)), size)
        impact = impacts(tf, np.repeat(np.array([n for _, _, n in made], dtype=np.int64), size), count, total)
        order = np.lexsort((place, -impact, term))
        term, place, impact = term[order], place[order], impact[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        nth = np.arange(len(term)) - np.repeat(first, np.diff(np.r_[first, len(term)]))
        tier = np.searchsorted(np.array(tiers), nth, side="right")
        begin = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tier[1:] != tier[:-1])])
        end = np.r_[begin[1:], len(term)]
        follows = np.r_[term[1:], -1][end - 1] == term[begin]
        residual = np.where(follows, np.r_[impact[1:], 0][end - 1], 0)
        names = np.empty(len(code), dtype=object)
        names[:] = list(code)
        schema = pa.schema([("block", pa.string()), ("tier", pa.int32()), ("term", pa.string()), ("places", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int32())), ("residual", pa.int32()), ("ids", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pydict({"block": [name], "tier": [0], "term": [None], "places": [None], "impacts": [None], "residual": [0], "ids": [ids]}, schema)
        for at in range(0, len(begin), 20_000):
            b, e = begin[at : at + 20_000], end[at : at + 20_000]
            offsets = pa.array(np.r_[b, e[-1]] - b[0], pa.int32())
            part = slice(b[0], e[-1])
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * len(b)),
                pa.array(tier[b], pa.int32()),
                pa.array(names[term[b]], pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(place[part], pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(impact[part], pa.int32())),
                pa.array(residual[at : at + 20_000], pa.int32()),
                pa.nulls(len(b), pa.list_(pa.int64())),
            ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        code: dict[bytes, int] = {}
        made: list[tuple[list[int], list[int], int]] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                counts = Counter(found)
                made.append(([code.setdefault(t, len(code)) for t in counts], list(counts.values()), len(found)))
                ids.append(doc_id)
                held += len(counts)
                if held >= block_postings:
                    yield from block_rows(f"{part}-{seq}", ids, code, made)
                    ids, code, made, seq, held = [], {}, [], seq + 1, 0
        if made:
            yield from block_rows(f"{part}-{seq}", ids, code, made)
        give_back()

    schema = "block string, tier int, term string, places array<int>, impacts array<int>, residual int, ids array<long>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class TieredIndex:
    """A written index: its vocabulary, its postings by tier, its totals."""

    def __init__(self, terms: DataFrame, folder: str, docs: int, total: int, tiers: int):
        self.terms, self.folder, self.docs, self.total, self.tiers = terms, folder, docs, total, tiers

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, block_postings: int = BLOCK_POSTINGS) -> TieredIndex:
        spark = docs.sparkSession
        terms = save(vocabulary(docs, text_col), "terms")
        found = terms.filter("term is null").first()
        count, total = (found.df, found.total) if found else (0, 0)
        folder = scratch_path(spark, "postings")
        if count:
            postings(docs, count, total, id_col, text_col, block_postings, tiers).write.partitionBy("tier").parquet(folder)
        return cls(terms.filter("term is not null").select("term", "df"), folder, count, total, len(tiers) + 1)

    def blocks(self) -> int:
        return self.read(0).filter("term is null").count()

    def read(self, deepest: int) -> DataFrame:
        """The postings of the tiers down to one; the others' folders aren't read."""
        spark = self.terms.sparkSession
        schema = "block string, term string, places array<int>, impacts array<int>, residual int, ids array<long>, tier int"
        return spark.read.schema(schema).parquet(self.folder).filter(F.col("tier") <= deepest)


def item_terms(items: DataFrame, index: TieredIndex, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, item_id, term, weight) of every item's distinct terms that the index has;
    key numbers the items' rows."""
    folded = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    rows = items.select(F.col(id_col).alias("item_id"), F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("terms"))
    rows = save(rows.withColumn("key", F.monotonically_increasing_id()), "items")
    weight = F.floor(1000 * F.log((2 * F.lit(index.docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    own = rows.select("key", "item_id", F.explode("terms").alias("term"))
    return own.join(index.terms, "term").select("key", "item_id", "term", weight.alias("weight"))


def search_blocks(rows: DataFrame, wanted: list[tuple[int, str, int]], floors: dict[int, int], k: int) -> DataFrame:
    """(block, key, doc_id, score, loose) of every block: an item's k best documents by what
    the read tiers give, none below its floor, and in a row without a document the
    highest score that a document of the block with anything left to gain may have."""
    by_item: dict[int, list[tuple[str, int]]] = {}
    for key, term, weight in wanted:
        by_item.setdefault(key, []).append((term, weight))
    shared = rows.sparkSession.sparkContext.broadcast((by_item, floors))

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = shared.value
        name = None
        lists: dict[str, tuple[list, list, int, int]] = {}
        ids, nulls = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        for batch in group:
            name = name or (batch.column("block")[0].as_py() if len(batch) else None)
            table = {c: batch.column(c) for c in ("term", "tier", "places", "impacts", "residual", "ids")}
            for at, (term, tier, residual) in enumerate(zip(table["term"].to_pylist(), table["tier"].to_pylist(), table["residual"].to_pylist())):
                if term is None:
                    own = table["ids"][at].values
                    nulls, ids = own.is_null().to_numpy(zero_copy_only=False), own.fill_null(2**63 - 1).to_numpy()
                    continue
                places, values = (table[c][at].values.to_numpy() for c in ("places", "impacts"))
                found = lists.setdefault(term, ([], [], [-1, 0]))
                found[0].append(places)
                found[1].append(values)
                if tier > found[2][0]:
                    found[2][:] = tier, residual
        keys, docs, scores, bounds = [], [], [], []
        for key, own in items.items():
            have = [(w, lists[t]) for t, w in own if t in lists and w > 0]
            if not have:
                continue
            place = np.concatenate([p for _, (parts, _, _) in have for p in parts])
            size = [sum(map(len, parts)) for _, (parts, _, _) in have]
            weight = np.repeat(np.array([w for w, _ in have], dtype=np.float64), size)
            # whole numbers far below 2 ** 53: sums of doubles are exact
            score = np.bincount(place, weight * np.concatenate([v for _, (_, parts, _) in have for v in parts]), len(ids))
            open_ = np.array([w * last[1] for w, (_, _, last) in have], dtype=np.float64)
            if open_.any():
                left = open_.sum() - np.bincount(place, np.repeat(open_, size), len(ids))
                bound = np.where(left > 0, score + left, 0).max(initial=0)
                keys.append(key)
                docs.append(None)
                scores.append(None)
                bounds.append(int(bound))
            good = np.flatnonzero(score >= max(1, least.get(key, 1)))
            if len(good) > k:
                kth = np.partition(score[good], len(good) - k)[len(good) - k]
                good = good[score[good] >= kth]
            best = good[np.lexsort((ids[good], nulls[good], -score[good]))][:k]
            keys += [key] * len(best)
            docs += [None if nulls[p] else int(ids[p]) for p in best]
            scores += score[best].astype(np.int64).tolist()
            bounds += [None] * len(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64()), pa.array(bounds, pa.int64())],
            ["block", "key", "doc_id", "score", "loose"],
        )

    return rows.groupBy("block").applyInArrow(run, "block string, key long, doc_id long, score long, loose long")


def best_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


POOL = "block string, key long, doc_id long, score long"


def ranks_of(rows: DataFrame, pairs: list[tuple[int, str, int]], floors: dict[int, int], k: int, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the rows give for the items, beside the documents kept from other blocks: all
    of the documents found (POOL); the k best of each item (key, rank, doc_id, score);
    and the open bounds (block, key, floor) that reach the score of the item's last rank."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(t,) for t in sorted({t for _, t, _ in pairs})], "term string")
    rows = rows.filter("term is not null").join(F.broadcast(asked), "term", "left_semi").unionByName(rows.filter("term is null"))
    found = save(search_blocks(rows, pairs, floors, k), "found")
    pool = found.filter("score is not null").select("block", "key", "doc_id", "score")
    pool = pool if kept is None else pool.unionByName(kept)
    # two steps, so that no task has all blocks' rows of an item
    some = best_of(pool.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(32))), ["key", "salt"], k)
    best = save(best_of(some, ["key"], k).select("key", "rank", "doc_id", "score"), "best")
    last = best.groupBy("key").agg(F.when(F.count("*") == k, F.min("score")).otherwise(1).alias("floor"))
    bounds = found.filter("loose is not null").join(last, "key", "left").filter(F.col("loose") >= F.coalesce("floor", F.lit(1)))
    return pool, best, save(bounds.select("block", "key", F.coalesce("floor", F.lit(1)).alias("floor")), "open")


def search(index: TieredIndex, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", at_once: int = ITEM_TERMS, ahead: int = AHEAD, log: list[tuple[int, int, int, int]] | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item. Of an index of
    many blocks the first tier of some, about ahead, is searched before the others: the last
    rank there is a floor for all, so the others give only what reaches it. Of the lower
    tiers only blocks are read where an item is still open. log gathers (tier, items
    searched, items proved, blocks read; 0 for all)."""
    spark = items.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    results = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not index.docs:
        return results
    wanted = save(item_terms(items, index, id_col, text_col), "wanted")
    parts = max(1, -(-wanted.count() // at_once))
    part = F.pmod(F.xxhash64("key"), F.lit(parts))
    every = index.blocks() // ahead
    for p in range(parts):
        # bounded by at_once, up to the hash's evenness
        block = wanted.filter(part == p) if parts > 1 else wanted
        pairs = [(r.key, r.term, r.weight) for r in block.select("key", "term", "weight").collect()]
        names = block.select("key", "item_id").distinct()
        floors: dict[int, int] = {}
        if every > 1 and pairs:
            some = index.read(0).filter(F.pmod(F.xxhash64("block"), F.lit(every)) == 0)
            best = ranks_of(some, pairs, floors, k)[1]
            floors = {r.key: r.floor for r in best.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k).collect()}
        kept = blocks = None
        for tier in range(index.tiers):
            if not pairs:
                break
            rows = index.read(tier) if blocks is None else index.read(tier).join(blocks, "block", "left_semi")
            pool, best, open_ = ranks_of(rows, pairs, floors, k, kept)
            # items that no block has anything for are proved, too: they find nothing
            floors = {r.key: r.floor for r in open_.select("key", "floor").distinct().collect()}
            searched = {key for key, _, _ in pairs}
            if log is not None:
                log.append((tier, len(searched), len(searched) - len(floors), 0 if blocks is None else blocks.count()))
            still = spark.createDataFrame([(key,) for key in floors], "key long")
            proved = best.join(F.broadcast(still), "key", "left_anti")
            results = results.unionByName(proved.join(names, "key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
            pairs = [x for x in pairs if x[0] in floors]
            blocks = save(open_.select("block").distinct(), "blocks")
            if pairs:
                kept = save(pool.join(F.broadcast(still), "key", "left_semi").join(blocks, "block", "left_anti"), "kept")
    return results


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = TieredIndex.build(spread_documents(spark, sf_dir))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: All documents scored for all items.
ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
d AS (SELECT doc_id, row_number() OVER () AS r, ts, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0),
g AS (SELECT count(*)::BIGINT AS cn, sum(n)::BIGINT AS l FROM d),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * cn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, cn),
i AS (SELECT DISTINCT k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM (SELECT *, row_number() OVER () AS k FROM benchmark)),
s AS (SELECT k, item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * cn) // l))))::BIGINT AS score FROM i JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), g GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 50"""
