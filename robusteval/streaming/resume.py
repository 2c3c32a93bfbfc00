"""Resumable ingest: append what is new, never a key twice."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener


def existing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


class Stopped(Exception):
    """Ends a run before its next batch writes anything."""


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a log, whichever runs and batches wrote them."""
    return existing(spark, path, schema).select(*schema.names)


class Watch(StreamingQueryListener):
    """Progress of one query as it runs, from the engine's own events: a row a batch,
    with what came in and what was new among it."""

    def __init__(self, run: str, tell: Callable[[dict], None]):
        self.run, self.tell, self.ended = run, tell, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) == self.run and (seen := p.observedMetrics.get("arrivals")) is not None:
            self.tell({"batch": p.batchId, "arrived": seen.arrived, "logged": seen.logged, "seconds": p.batchDuration / 1000})

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.ended.set()


def append_new(source: DataFrame, keys: list[str], out: str, checkpoint: str, progress: Callable[[dict], None] | None = None, should_stop: Callable[[], bool] | None = None, watch: Callable[[dict], None] | None = None) -> int:
    """Drains a streaming source into a Parquet log, each key once over all runs.

    The keys that were seen are streaming state, kept on disk and checkpointed by its
    changes, so a batch costs what it brings, however long the log is. A checkpoint
    that begins beside a log takes the log's keys in once, as rows of its first batch
    that are never written: they fill the state, and the first batch leaves out what
    the log has. So a lost checkpoint costs one scan of the log's keys and no
    duplicate. Each batch writes a folder of its own, named by checkpoint and batch; a
    batch that is replayed replaces it.

    Returns the number of batches. should_stop is asked before each batch: it ends the
    run between batches, and the batch that was due is the next run's first. progress
    is told of each batch once it is written, watch by the engine's listener.
    """
    spark, schema, seen = source.sparkSession, source.schema, {"batches": 0}
    run, known = hashlib.sha256(checkpoint.encode()).hexdigest()[:12], f"{checkpoint}-known"
    kinds = T.StructType([schema[k] for k in keys])
    if not folder_exists(spark, f"{known}/_SUCCESS"):
        existing(spark, out, schema).select(*keys).distinct().write.mode("overwrite").parquet(known)
    logged = spark.readStream.schema(kinds).parquet(known).withColumn("__logged", F.lit(True))
    both = source.withColumn("__logged", F.lit(False)).unionByName(logged, allowMissingColumns=True)
    both = both.observe("arrivals", F.count_if(~F.col("__logged")).alias("arrived"), F.count_if("__logged").alias("logged"))

    def put(batch: DataFrame, batch_id: int) -> None:
        if should_stop and should_stop():
            raise Stopped
        fresh = batch.filter("not __logged").drop("__logged")
        if batch_id == 0:
            fresh = fresh.join(batch.sparkSession.read.schema(kinds).parquet(known), keys, "left_anti")
        fresh.select(*schema.names).write.mode("overwrite").parquet(f"{out}/log_run={run}/log_batch={batch_id}")
        seen["batches"] += 1
        if progress:
            progress({"batch": batch_id, "batches": seen["batches"]})

    provider, before = "spark.sql.streaming.stateStore.providerClass", {}
    for name, value in ((provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"), ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")):
        before[name] = spark.conf.get(name, None)
        spark.conf.set(name, value)
    query = both.dropDuplicates(keys).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    listener = Watch(str(query.runId), watch) if watch else None
    if listener:
        spark.streams.addListener(listener)
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not (should_stop and should_stop()):
            raise
    finally:
        if listener:
            listener.ended.wait(10)  # its events come after the query's own end
            spark.streams.removeListener(listener)
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return seen["batches"]


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def progress_report(plan: DataFrame, done: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """One row: completed and expected keys, and whether the run is whole."""
    both = plan.select(*keys).distinct().join(done.select(*keys).distinct().withColumn("done", F.lit(1)), keys, "left")
    out = both.agg(F.count("*").alias("expected_records"), F.count("done").alias("completed_records"))
    return out.withColumn("complete", F.col("expected_records") == F.col("completed_records")).withColumn("config_fingerprint", F.lit(fingerprint))


def check_fingerprint(stored: str | None, current: str) -> None:
    """A run may only go on under the settings it began with."""
    if stored is not None and stored != current:
        raise RuntimeError("the stored run has other settings")


class StopFlag:
    """Set by a signal; the loop above ends after its batch."""

    def __init__(self) -> None:
        self.stopped = False

    def install(self, *signals: int) -> StopFlag:
        import signal

        for s in signals or (signal.SIGTERM,):
            signal.signal(s, self.set)
        return self

    def set(self, *_: object) -> None:
        self.stopped = True

    def __call__(self) -> bool:
        return self.stopped


def generate(plan: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], prompt: str = "prompt_text", batch: int = 64) -> DataFrame:
    """plan with raw_output from an outside generator: make() builds it on the worker
    when its first prompt comes, so an empty plan loads nothing."""
    import pandas as pd

    schema = T.StructType([*plan.schema.fields, T.StructField("raw_output", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            if len(pdf):
                model = model or make()
                texts = pdf[prompt].tolist()
                pdf["raw_output"] = [x for at in range(0, len(texts), batch) for x in model(texts[at : at + batch])]
                yield pdf

    return plan.mapInPandas(run, schema)


def retry_pending(expected: DataFrame, attempts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, attempt): what a further round makes: keys never accepted and tried fewer
    than so many times. attempts: (keys, attempt, accepted)."""
    tried = attempts.groupBy(*keys).agg(F.max("attempt").alias("last"), F.coalesce(F.some("accepted"), F.lit(False)).alias("ok"))
    rest = expected.join(tried, keys, "left").filter(~F.coalesce("ok", F.lit(False)) & (F.coalesce("last", F.lit(0)) < most))
    return rest.select(*keys, (F.coalesce("last", F.lit(0)) + 1).alias("attempt"))
