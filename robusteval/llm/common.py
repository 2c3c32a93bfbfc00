"""Shared parts of the corpus operators: scratch tables, components, text access.

Scratch tables live below the folder named by ``spark.checkpoint.dir``, which
the driver and every executor share; a lost executor therefore loses none of
them. Only on a local master, where one machine is all there is, may the setting
be absent; a folder of our own is made then.

A result may read scratch tables until it is consumed. What an operator itself
no longer needs it deletes; ``scratch`` deletes what was made within it, and the
rest goes when the application ends.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robusteval.session import spread

#: Separators of words: space and the six ASCII controls from tab to return.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
#: Folders made and not yet deleted, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, from the session's settings."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="robusteval-")
            atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        base = "file://" + _own_dirs[app]
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    if not _made:
        atexit.register(_end)
    _made.append(f"{shared_dir(spark)}/robusteval/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _end() -> None:
    """Deletes what is left, if the application still runs."""
    if SparkContext._active_spark_context is not None and (spark := SparkSession.getActiveSession()):
        for path in _made:
            remove(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the scratch tables made within it when it ends, but for the paths put
    into the list it gives."""
    before, keep = set(_made), []
    try:
        yield keep
    finally:
        for path in [p for p in _made if p not in before and p not in keep]:
            remove(spark, path)
            _made.remove(path)


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a scratch table and reads it back: this cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fewer(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df, known to have about so many rows, in no more partitions than they need:
    small tables then are few files, however many partitions made them."""
    return df.coalesce(max(1, -(-rows // each)))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, wherever it lies."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def last_saved() -> str:
    """The folder of the table saved last."""
    return _made[-1]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table by its folder."""
    remove(spark, path)
    if path in _made:
        _made.remove(path)


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables made by save() that nothing reads any more."""
    for df in tables:
        if df is not None and (files := df.inputFiles()):
            folder = files[0].rsplit("/", 1)[0]
            remove(df.sparkSession, folder)
            for path in [p for p in _made if p.rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]]:
                _made.remove(path)


def give_back() -> None:
    """Returns what a worker has freed to the system: it lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def temp_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name += "_"
    return name


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt over the cores if their scan has only a task or two."""
    return spread(documents(spark, sf_dir))


def hash_order_sample(ids: DataFrame, rows: int, *columns: str) -> DataFrame:
    """The given number of rows whose hashed ids come first: the same on any run. A
    cutoff on the hash first leaves about twice as many, so no task gathers the
    first rows of every partition of a large table."""
    key, total = F.xxhash64(*columns), ids.count()
    share = (2 * rows + 1000) / max(1, total)
    if share < 1:
        ids = ids.filter(key < F.lit(int(share * 2**64) - 2**63))
    return ids.orderBy(key, *columns).limit(rows)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For n items and index pairs: the smallest index of each item's component."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        if not len(left):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            jump = root[root]
            if np.array_equal(jump, root):
                break
            root = jump
    return root


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component the
    smallest id reachable. Ids without an edge to another id are not returned.

    Each round points every node at its smallest neighbour, follows the pointers
    twice and contracts the graph, so even a chain shrinks to a quarter. Minima
    are combined before the shuffle, joins on a hub are left to the skew join,
    and nothing but the test for emptiness reaches the driver.
    """
    a, b = F.col("a"), F.col("b")
    rest = save(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(a < b).distinct(), "edges")
    labels, known = None, 0
    while n := rest.count():
        known = known or 2 * n
        both = rest.select(a.alias("id"), b.alias("nb")).union(rest.select(b.alias("id"), a.alias("nb")))
        step = both.groupBy("id").agg(F.least("id", F.min("nb")).alias("to"))
        spent = []
        for _ in range(2):
            step = save(fewer(step, 2 * n), "pointers")
            spent.append(step)
            nxt = step.select(F.col("id").alias("to"), F.col("to").alias("to2"))
            step = step.join(nxt, "to").select("id", F.col("to2").alias("to"))
        step = save(fewer(step, 2 * n), "pointers")
        if labels is None:
            labels = save(step.select("id", F.col("to").alias("component")), "labels")
        else:
            moved = step.select(F.col("id").alias("component"), "to")
            spent.append(labels)
            labels = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            labels = save(fewer(labels, known), "labels")
        p = step.select(F.col("id").alias("a"), F.col("to").alias("pa"))
        q = step.select(F.col("id").alias("b"), F.col("to").alias("pb"))
        joined = rest.join(p, "a").join(q, "b").filter(F.col("pa") != F.col("pb"))
        left = save(fewer(joined.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), n), "edges")
        drop(rest, step, *spent)
        rest = left
    if labels is None:
        return rest.select(a.alias("id"), b.alias("component"))
    drop(rest)
    return labels
