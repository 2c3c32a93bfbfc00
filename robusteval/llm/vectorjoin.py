"""Exact metric range join of embeddings, for near-duplicate removal.

Pivots cut the unit sphere into cells: a vector's home is the cell of its
nearest pivot. With t the largest angle of a link, a vector x of home i can have
a partner in cell j only if

* angle(x, p_j) <= angle(x, p_i) + 2 t        (triangle inequality, twice),
* angle(x, p_j) <= radius of cell j + t        (triangle inequality), and
* x . (p_i - p_j) <= 2 sin(t / 2) |p_i - p_j|  (distance to the bisector).

Such an x is replicated to j if i < j, so each pair of vectors is compared in
exactly one cell. Cells join independently; one whose vectors exceed a task's
memory is dealt into slices whose pairs are units of their own. A unit is a few
products of two matrices in double precision and returns link counts and a
spanning forest, never its pairs.

The number of pivots follows the structure of the vectors: of 16, 64, 256, 1024
and 2048 that one is taken which a bounded sample says makes the least work of
copies and comparisons. It decides only what is compared, never what is linked.

Equal vectors are collapsed first and weigh as many as they are. Vectors of each
length are compared among themselves; the length is part of the cell.

Defined results: a vector that is null or zero or holds null or non-finite
components links with nothing. Links and components belong to vectors, not ids:
rows that repeat an id with another vector have their own links and component.
A null id links like any other but names no component (null if no id is
reachable) and isn't kept. Ties in the nearest pivot go to the first; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robusteval.llm.common import components, hash_order_sample, local_roots, save

#: Room for rounding in bounds that only decide what is compared.
SLACK = 1e-7
#: Numbers of pivots to choose from, and what a copy (made, shuffled, read) costs
#: in comparisons.
PIVOTS = (16, 64, 256, 1024, 2048)
COPY = 2000
#: Bytes of the sample from which pivots are picked, and of one side of a unit.
SAMPLE_BYTES = 1 << 24
SIDE_BYTES = 1 << 25
MAX_SIDE = 16_384
#: Cells of a matrix held at a time, and rows whose bounds are worked out at once.
CELLS = 1 << 22
CHUNK = CELLS // max(PIVOTS)

def unit_rows(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64)
    with np.errstate(over="ignore"):
        x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of a unit sample chosen one by one, each the farthest from those before."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        k = int(np.argmin(nearest))
        if nearest[k] > 1 - 1e-9:
            break
        chosen.append(k)
        nearest = np.maximum(nearest, sample @ sample[k])
    return sample[chosen]


def homes(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot and angle to every pivot."""
    dots = np.clip(x @ pivots.T, -1, 1)
    return dots.argmax(axis=1), np.arccos(dots)


def radii(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Largest angle from each pivot to a row at home with it; minus infinity if none."""
    out = np.full(len(pivots), -np.inf)
    home, angle = homes(x, pivots)
    np.maximum.at(out, home, angle[np.arange(len(x)), home])
    return out


def reachable(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cells, and for each row the other cells its partners may be at home in."""
    home, angle = homes(x, pivots)
    rows = np.arange(len(x))
    own = angle[rows, home][:, None]
    near = (angle <= own + 2 * limit + SLACK) & (angle <= radius[None, :] + limit + SLACK)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    dots = x @ pivots.T
    near &= dots[rows, home][:, None] - dots <= 2 * math.sin(limit / 2) * apart + SLACK
    near[rows, home] = False
    return home, near


def compare_unit(keys: np.ndarray, weight: np.ndarray, x: np.ndarray, first: np.ndarray, within: bool, cosine: float) -> pd.DataFrame:
    """One unit: (key, links, root) of its linked rows. Rows of the first side are
    compared with the others and, if within, among themselves."""
    p, q = np.flatnonzero(first), np.flatnonzero(~first)
    links = np.zeros(len(keys), dtype=np.int64)
    root = np.arange(len(keys))
    sides = ([(p, p, True)] if within else []) + ([(p, q, False)] if len(q) else [])
    for a, b, same in sides:
        step, y = max(1, CELLS // max(1, len(b))), x[b]
        for at in range(0, len(a), step):
            part = a[at : at + step]
            left, right = np.nonzero(x[part] @ (y[: at + len(part)] if same else y).T >= cosine)
            left, right = part[left], b[right]
            if same:
                left, right = left[left > right], right[left > right]
            np.add.at(links, left, weight[right])
            np.add.at(links, right, weight[left])
            root = merged(root, left, right)
    hit = links > 0
    return pd.DataFrame({"key": keys[hit], "links": links[hit], "root": keys[root[hit]]})


def merged(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Roots after more links between rows."""
    if not len(left):
        return root
    return local_roots(len(root), root[left], root[right])[root]


def side(dim: int) -> int:
    """Rows of one side of a unit: what fits into its bytes."""
    return max(16, min(MAX_SIDE, SIDE_BYTES // (8 * max(1, dim))))


def choose_pivots(x: np.ndarray, total: int, limit: float, block: int, counts: tuple[int, ...] = PIVOTS) -> np.ndarray:
    """Pivots from one half of a unit sample of total vectors: as many of the given
    counts as make the least work, by the copies and comparisons the other half
    foretells."""
    points = spread_pivots(x[::2], max(counts))
    x = x[1::2] if len(x) > 1 else x
    best, least = points[: min(counts)], math.inf
    for count in sorted({min(c, len(points)) for c in counts}):
        some = points[:count]
        radius, home, replicas = radii(x, some), np.zeros(count), np.zeros(count)
        # Cells few sampled rows are at home in hold farther ones than those.
        radius = np.maximum(radius, np.median(radius[np.isfinite(radius)]))
        for at in range(0, len(x), CHUNK):
            own, near = reachable(x[at : at + CHUNK], some, radius, limit)
            home += np.bincount(own, minlength=count)
            replicas += (near & (np.arange(count)[None, :] > own[:, None])).sum(axis=0)
        home, replicas = home * total / len(x), replicas * total / len(x)
        h, o = np.ceil(home / block), np.maximum(1, np.ceil(replicas / block))
        work = (home * home / 2 + home * replicas).sum() + COPY * (home * (o + h - 1) + replicas * h).sum()
        if work < least:
            best, least = some, work
    return best


def _by_length(pdf: pd.DataFrame, pivots: dict[int, np.ndarray]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray | None]]:
    """Chunks of rows of one length, as unit vectors, with that length's pivots."""
    for dim, rows in pdf.groupby(pdf["vector"].map(len)):
        for at in range(0, len(rows), CHUNK):
            part = rows.iloc[at : at + CHUNK]
            yield int(dim), part, unit_rows(part["vector"]), pivots.get(int(dim))


def _radii(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, _, x, points in _by_length(pdf, pivots):
                if points is not None:
                    far[dim] = np.maximum(far.get(dim, -np.inf), radii(x, points))
        for dim, r in far.items():
            yield pd.DataFrame({"dim": dim, "cell": np.arange(len(r), dtype=np.int32), "radius": r})[np.isfinite(r)]

    return run


def _cells(pivots: dict[int, np.ndarray], radius: dict[int, np.ndarray], limit: float, count: bool):
    """Rows with the cells they belong to, or only how many belong to each. A length
    without a pivot has one cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int, bool], int] = {}
        for pdf in batches:
            for dim, part, x, points in _by_length(pdf, pivots):
                home, row, cell = np.zeros(len(part), dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
                if points is not None:
                    home, near = reachable(x, points, radius[dim], limit)
                    row, cell = np.nonzero(near & (np.arange(len(points))[None, :] > home[:, None]))
                if count:
                    for cells, at_home in ((home, True), (cell, False)):
                        for c, n in zip(*np.unique(cells, return_counts=True)):
                            seen[dim, int(c), at_home] = seen.get((dim, int(c), at_home), 0) + int(n)
                    continue
                for at in range(0, len(part) + len(row), CHUNK):
                    take = np.r_[np.arange(len(part)), row][at : at + CHUNK]
                    out = part.iloc[take].reset_index(drop=True)
                    out["dim"] = np.int32(dim)
                    out["cell"] = np.r_[home, cell][at : at + CHUNK].astype(np.int32)
                    out["at_home"] = (np.arange(at, at + len(take)) < len(part))
                    yield out
        if count:
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["dim", "cell", "at_home", "n"]).astype({"dim": "int32", "cell": "int32", "at_home": "bool", "n": "int64"})

    return run


def _compare(cosine: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        within = key[2] and key[4] == 0
        return compare_unit(pdf["key"].to_numpy(), pdf["weight"].to_numpy(), unit_rows(pdf["vector"]), pdf["first"].to_numpy(), within, cosine)

    return run


def _unit(near: Column, s: Column, t: Column, first: Column) -> Column:
    return F.struct(near.alias("near"), s.cast("int").alias("s"), t.cast("int").alias("t"), first.alias("first"))


def units(dealt: DataFrame, sizes: DataFrame, block: int | None) -> DataFrame:
    """dealt (dim, cell, at_home, key, ...) with the units each row is part of: (near,
    s, t) and whether it is of the first side. Home slice s meets the replicated
    slice t (near; at t = 0 also itself) and every other home slice."""
    most = F.least(F.lit(MAX_SIDE), F.greatest(F.lit(16), F.floor(SIDE_BYTES / (8 * F.greatest(F.col("dim"), F.lit(1)))))) if block is None else F.lit(block)
    slices = F.ceil(F.sum(F.when(F.col("at_home"), F.col("n")).otherwise(0)) / F.first(most)), F.ceil(F.sum(F.when(F.col("at_home"), 0).otherwise(F.col("n"))) / F.first(most))
    cut = sizes.groupBy("dim", "cell").agg(F.greatest(slices[0], F.lit(1)).cast("int").alias("h"), F.greatest(slices[1], F.lit(1)).cast("int").alias("o"))
    mine = F.pmod(F.xxhash64("key"), F.when(F.col("at_home"), F.col("h")).otherwise(F.col("o")).cast("long")).cast("int")
    rows = dealt.join(cut, ["dim", "cell"]).withColumn("slice", mine)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    yes, no, own = F.lit(True), F.lit(False), F.col("slice")
    met = F.transform(upto("o"), lambda t: _unit(yes, own, t, yes))
    across = F.transform(F.filter(upto("h"), lambda z: z != own), lambda z: _unit(no, F.least(own, z), F.greatest(own, z), own < z))
    replica = F.transform(upto("h"), lambda s: _unit(yes, s, own, no))
    return rows.select("dim", "cell", "key", "weight", "vector", F.inline(F.when(F.col("at_home"), F.concat(met, across)).otherwise(replica)))


def find_links(distinct: DataFrame, cosine: float, pivots: tuple[int, ...] = PIVOTS, block: int | None = None) -> DataFrame:
    """(key, links, root) of distinct (key, weight, vector): link counts and a spanning
    forest, in parts that are yet to be summed and joined."""
    limit = math.acos(cosine)
    kind = dict(distinct.dtypes)["vector"]
    longest = distinct.agg(F.max(F.size("vector"))).first()[0]
    total = distinct.count()
    rows = max(64, min(4 * max(pivots), SAMPLE_BYTES // (8 * longest)))
    picked: dict[int, list] = {}
    for r in hash_order_sample(distinct.select("key", "vector"), rows, "key").collect():
        picked.setdefault(len(r.vector), []).append(r.vector)
    size = sum(map(len, picked.values()))
    points = {dim: choose_pivots(unit_rows(v), max(1, total * len(v) // size), limit, block or side(dim), pivots) for dim, v in picked.items()}
    radius = {dim: np.full(len(p), -np.inf) for dim, p in points.items()}
    far = distinct.select("vector").mapInPandas(_radii(points), "dim int, cell int, radius double")
    for r in far.groupBy("dim", "cell").agg(F.max("radius").alias("radius")).collect():
        radius[r.dim][r.cell] = r.radius
    counted = distinct.select("vector").mapInPandas(_cells(points, radius, limit, True), "dim int, cell int, at_home boolean, n long")
    sizes = save(counted.groupBy("dim", "cell", "at_home").agg(F.sum("n").alias("n")), "sizes")
    dealt = distinct.mapInPandas(_cells(points, radius, limit, False), f"key long, weight long, vector {kind}, dim int, cell int, at_home boolean")
    dealt = units(dealt, sizes, block)
    return dealt.groupBy("dim", "cell", "near", "s", "t").applyInPandas(_compare(cosine), "key long, links long, root long")


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, pivots: tuple[int, ...] = PIVOTS, block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    block: rows of one side of a unit; by default what fits into SIDE_BYTES.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    of = vectors.schema[vector_col].dataType
    kind = "array<float>" if of.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    distinct = rows.filter(fine).groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    # The key is fixed by being written: save() cuts the lineage.
    distinct = save(distinct.withColumn("key", F.monotonically_increasing_id()), "vectors")
    if distinct.isEmpty():
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = save(find_links(distinct.select("key", "weight", "vector"), cosine, pivots, block), "links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("root").alias("a"), F.col("key").alias("b"))).withColumnRenamed("id", "key")
    nodes = distinct.select("key", "id", "weight").join(counts, "key", "left").join(named, "key", "left")
    nodes = save(nodes.withColumn("component", F.coalesce("component", "key")), "nodes")
    smallest = nodes.groupBy("component").agg(F.min("id").alias("component_id"))
    nodes = nodes.join(smallest, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.lit(True).alias("linked"))
    nodes = distinct.select("key", "vector").join(nodes, "key").drop("key")
    out = rows.join(nodes, "vector", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op6_vector_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
