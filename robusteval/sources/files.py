"""Files: JSON lines, Parquet, CSV queues and sheets, YAML, small reports."""

from __future__ import annotations

import json
import os
import platform
import subprocess
import tempfile
import uuid
from datetime import UTC, datetime
from html import escape
from importlib import metadata
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from robusteval import constants as C
from robusteval.operators.lifecycle import pinned

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one all machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="robusteval-"))
    return f"{base.rstrip('/')}/robusteval-files/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines under a schema; malformed rows stop the query, blank lines are
    skipped, a path without files is an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line) of text files, numbers from 1 within a file. Files are read
    in ranges of bytes like any others: each range counts its lines, and the counts
    before it, a few rows, say where its numbers begin."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )
    counts = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")
    starts = counts.select(F.col("file").alias("of"), F.col("block").alias("from"), (before - F.col("first") + 1).alias("shift"))
    found = lines.join(starts, (F.col("file") == F.col("of")) & (F.col("block") == F.col("from")))
    return found.select("file", (F.col("at") + F.col("shift")).alias("number"), "line")


def is_object(line: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))


def read_numbered_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with their file and line number; a line that is no object stops the
    query with ``file:number``. Blank lines are skipped, but counted."""
    rows = numbered_lines(spark, path).filter(F.trim("line") != "")
    told = F.raise_error(F.concat("file", F.lit(":"), F.col("number").cast("string"), F.lit(" is no JSON object")))
    checked = rows.withColumn("line", F.when(is_object("line"), F.col("line")).otherwise(told.cast("string")))
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return checked.select("file", "number", F.from_json("line", kind).alias("row")).select("file", "number", "row.*")


def first_bad_line(spark: SparkSession, path: str) -> str | None:
    """file:line of the first line that is no JSON object, for messages."""
    bad = numbered_lines(spark, path).filter((F.trim("line") != "") & ~is_object("line"))
    row = bad.orderBy("file", "number").first()
    return None if row is None else f"{row.file}:{row.number}"


def append_jsonl(df: DataFrame, path: str, token: str | None = None) -> int:
    """Appends rows as JSON lines; returns how many. Rows are written beside the table by
    a committed job, counted in what was committed, and put in place under names made
    of the token; a manifest ends the append. An append of a token whose manifest is
    there adds nothing and returns its count, and one that broke off is finished or
    begun again without a row twice, so an append may be repeated until it is done."""
    spark, token = df.sparkSession, token or uuid.uuid4().hex
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path
    store = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    manifest, beside = f"{path}/_appended/{token}.json", f"{path}/_pending/{token}"
    if store.exists(place(manifest)):
        return json.loads(spark.read.text(manifest, wholetext=True).first()[0])["rows"]
    count = f"{beside}.count.json"
    if not store.exists(place(count)):
        df.write.mode("overwrite").json(beside)
        rows = spark.read.text(beside).count()
        write_json(spark, count, {"rows": rows})
    rows = json.loads(spark.read.text(count, wholetext=True).first()[0])["rows"]
    moved = [f.getPath() for f in store.listStatus(place(beside)) if f.getPath().getName().startswith("part-")] if store.exists(place(beside)) else []
    for part in moved:
        if not store.rename(part, place(f"{path}/{token}-{part.getName()}")):
            raise OSError(f"{part} could not be moved into {path}")
    write_json(spark, manifest, {"rows": rows, "token": token})
    for left in (beside, count):
        store.delete(place(left), True)
    return rows


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_queue(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The queue's columns as CSV with a header; absent ones are empty."""
    names = columns or C.QUEUE
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text; a byte order mark is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system that Spark reaches: written beside its place,
    then renamed into it, so a reader finds the old one or the new one whole."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = store.create(beside, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    except BaseException:
        stream.close()
        store.delete(beside, False)
        raise
    stream.close()
    if not store.rename(beside, place):
        store.delete(place, False)
        if not store.rename(beside, place):
            raise OSError(f"{path} could not be replaced")


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small report in sorted order."""
    write_text(spark, path, json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n")


def read_yaml(path: str) -> dict:
    import yaml

    value = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def utc_now() -> str:
    return datetime.now(UTC).isoformat()


def cell(value) -> str:
    if isinstance(value, float):
        return f"{value:.6g}"
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def markdown(title: str, tables: dict[str, DataFrame], note: str = "") -> str:
    """A report of small tables, each under its name, one line a row."""
    out = f"# {title}\n" + (f"\n{note}\n" if note else "")
    for name, df in tables.items():
        right = {c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint")}
        head = " | ".join(df.columns), " | ".join("---:" if c in right else "---" for c in df.columns)
        body = sorted(" | ".join(map(cell, row)) for row in df.collect())
        out += f"\n## {name}\n\n" + "".join(f"| {line} |\n" for line in (*head, *body))
    return out


def scatter(points: DataFrame, x: str, y: str, label: str, size: tuple[int, int] = (720, 480)) -> str:
    """Points with their labels as an SVG figure; rows without a place are left out."""
    rows = [(r[x], r[y], str(r[label])) for r in points.select(x, y, label).filter(F.col(x).isNotNull() & F.col(y).isNotNull()).collect()]
    width, height, edge = *size, 60

    def scale(values: list[float], low: int, high: int):
        least, most = min(values, default=0.0), max(values, default=1.0)
        return lambda v: low + (v - least) / ((most - least) or 1.0) * (high - low)

    across, up = scale([r[0] for r in rows], edge, width - 2 * edge), scale([r[1] for r in rows], height - edge, edge)
    marks = "".join(f'<circle cx="{across(a):.1f}" cy="{up(b):.1f}" r="4"/><text x="{across(a) + 6:.1f}" y="{up(b) - 6:.1f}" font-size="10">{escape(name)}</text>' for a, b, name in sorted(rows))
    axes = f'<path d="M{edge} {edge}V{height - edge}H{width - edge}" fill="none" stroke="black"/><text x="{width // 2}" y="{height - 20}">{escape(x)}</text><text x="10" y="{edge - 20}">{escape(y)}</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{axes}{marks}</svg>\n'


def environment(spark: SparkSession, label: str = "") -> dict:
    """What a run was made with: versions, settings, packages, devices, scheduler."""
    names = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone")
    try:
        devices = subprocess.run(["nvidia-smi", "-L"], capture_output=True, text=True, check=False).stdout.split("\n")
    except OSError:
        devices = []
    return {
        "label": label,
        "recorded_at": utc_now(),
        "spark": spark.version,
        "python": platform.python_version(),
        "platform": platform.platform(),
        "settings": {n: str(spark.conf.get(n, None)) for n in names},
        "packages": sorted({f"{d.name}=={d.version}" for d in metadata.distributions()}),
        "devices": [d for d in devices if d],
        "scheduler": {k: v for k, v in sorted(os.environ.items()) if k.startswith("SLURM_")},
    }


def read_hub(spark: SparkSession, path: str, fmt: str, question: str, answer: str, ids: list[str], revision: str | None = None) -> DataFrame:
    """A data set in any format Spark reads, with its columns mapped. With a revision,
    which must be a pinned one, the copy below the folder of that name is read."""
    df = spark.read.format(fmt).load(path if revision is None else f"{path.rstrip('/')}/{pinned(revision, artifact=path)}")
    return df.select(F.col(question).cast("string").alias("question"), F.col(answer).cast("string").alias("answer"), *[F.col(c).cast("string").alias(c) for c in ids if c in df.columns])
