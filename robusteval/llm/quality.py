"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Word, symbol, line and repetition counts of whole texts become a vector of four
transformed statistics. For each language and source (and for each language, and
for all rows) the three quarters of rows of least covariance determinant are
sought by concentration steps from three deterministic starts: medians with
quartile ranges, mean with covariance, and medians with the least spreads. Every
step orders a group's rows by Mahalanobis distance and re-estimates from the
nearest ones; the start that ends with the least determinant counts. A row whose
squared distance from its group's final estimate exceeds a cutoff is rejected.

A step is one aggregation. Distances fall into logarithmic bins, sums and cross
sums are kept per group and bin (at most ``MAX_BIN - MIN_BIN`` of them, whatever
the group's size), and the nearest share is read off the cumulated bins; so a hot
source costs no more memory than any other.

No group rests on a few rows of its own: its estimate is pooled with its language's,
and the language's likewise with that of all rows. Pooled like two samples, the
spread includes the distance of the two centres, so a clean source that differs from
its language is not judged by its own narrow spread around a centre that is not its
own. The centre's weight is n**3 / (n**3 + CENTRE**3) for n rows: far rows of a group
of three or four are rejected, those of a group of ten are its ordinary rows. The
language's covariance counts as ``PRIOR`` rows. The weights follow from row counts
smoothly; no group size is treated apart.

The estimates are regularised: every statistic has a least spread (``FLOORS``),
and no eigenvalue of a covariance, measured in these units, is taken below one.
Where most rows agree exactly (no symbols at all), the floor is the unit.

Defined results: a null text is empty and fails the base rule; null languages
and sources are groups like any other; a null doc_id is kept as it is; equal
rows get equal results; ties in distance are taken together; the distance is null
where no row at all passes the base rule; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from robusteval.llm.common import drop, give_back, save, spread_documents

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Coordinates and the least spread each can have: logarithm of the mean
#: word length, symbols a word, repeated lines a line, repeated words a word.
COORDS = ("x0", "x1", "x2", "x3")
FLOORS = (0.06, 0.07, 0.12, 0.1)
#: Share of a group's rows that its estimate rests on.
SHARE = 0.75
#: Squared distance beyond which a row is rejected: the 0.999 quantile of the
#: chi-squared distribution of four degrees of freedom.
CUTOFF = 18.467
STEPS = 5
#: Rows that the covariance above a group counts for, and rows at which a group's own
#: centre counts as much as the one above it.
PRIOR, CENTRE = 60, 18
MIN_BIN, MAX_BIN = -64, 192


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated
    windows, and lines with a word, of UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    n = len(words)
    outside = len(text) - sum(map(len, words))
    chars = len(text.decode("utf-8", "replace")) - outside
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(windows)) < len(windows):
            repeated = covered(windows, n)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def covered(windows: list[tuple], n: int) -> int:
    """Words within a window that occurs twice or more."""
    seen: dict[tuple, int] = {}
    mark = np.zeros(n + 1, dtype=np.int64)
    for at, w in enumerate(windows):
        first = seen.setdefault(w, at)
        if first != at:
            for k in (first, at):
                mark[k] += 1
                mark[min(n, k + WINDOW)] -= 1
    return int((np.cumsum(mark[:n]) > 0).sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def count_texts(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """The given columns, then n_words .. n_lines, of the last column's texts."""
    picked = docs.select(*columns)
    schema = T.StructType([*picked.schema.fields, *[T.StructField(n, T.LongType()) for n in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *count_columns(batch.column(batch.num_columns - 1))], [*batch.schema.names, *COUNTS])
        give_back()

    return picked.mapInArrow(run, schema)


def count_columns(texts: pa.Array) -> list[pa.Array]:
    rows = [text_counts(t.as_py()) for t in texts.cast(pa.binary())]
    table = np.array(rows, dtype=np.int64).reshape(-1, len(COUNTS))
    return [pa.array(table[:, k]) for k in range(len(COUNTS))]


def counts_of(text: Column) -> Column:
    """struct(n_words .. n_lines) of a text. Only texts go to the Python workers, and
    none come back; called nondeterministic so that the plan holds the call once."""

    @F.arrow_udf("struct<" + ", ".join(f"{n}: bigint" for n in COUNTS) + ">")
    def run(texts: pa.Array) -> pa.Array:
        out = pa.StructArray.from_arrays(count_columns(texts), list(COUNTS))
        give_back()
        return out

    return run.asNondeterministic()(text)


def coordinates() -> list[Column]:
    """The statistic vector. Pseudo-counts temper the ratios of short texts."""
    w = F.col("n_words")
    return [
        F.log((F.col("word_chars") + 100) / (w + 20.0)).alias("x0"),
        F.log1p(F.col("n_symbols") / (w + 5.0)).alias("x1"),
        (F.col("n_dup_lines") / (F.col("n_lines") + 4.0)).alias("x2"),
        (F.col("n_repeat_words") / (w + 20.0)).alias("x3"),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def group_id(*parts: Column | str) -> Column:
    """A number for all rows (no part), a language, or a language and source. Null
    is a value of its own."""
    flat = [x for p in parts for x in (F.isnull(p), F.coalesce(p, F.lit("")))]
    return F.xxhash64(F.lit(len(parts)), *flat)


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(COORDS)) for j in range(i, len(COORDS))]


def distance() -> Column:
    """Squared Mahalanobis distance of x from centre m with inverse covariance p."""
    d = [F.col(c) - F.col("m")[k] for k, c in enumerate(COORDS)]
    terms = [F.col("p")[n] * d[i] * d[j] * (1 if i == j else 2) for n, (i, j) in enumerate(_pairs())]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.when(out.isNotNull(), F.greatest(out, F.lit(0.0)))


def bin_of(d2: Column) -> Column:
    """Eight bins for each doubling of the distance."""
    return F.greatest(F.lit(MIN_BIN), F.least(F.lit(MAX_BIN), F.floor(F.log2(d2 + 1e-12) * 8))).cast("int")


def floored(cov: np.ndarray) -> np.ndarray:
    """cov with no eigenvalue below one in units of the least spreads."""
    unit = np.outer(FLOORS, FLOORS)
    w, v = np.linalg.eigh(cov / unit)
    return (v * np.maximum(w, 1.0)) @ v.T * unit


def inverse(cov: np.ndarray) -> list[float]:
    p = np.linalg.inv(cov)
    return [float(p[i, j]) for i, j in _pairs()]


def moments(part: pd.DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean and covariance from sums and cross sums."""
    n = float(part["n"].sum())
    mean = np.array([part[f"s{k}"].sum() for k in range(len(COORDS))]) / n
    cov = np.zeros((len(COORDS), len(COORDS)))
    for k, (i, j) in enumerate(_pairs()):
        cov[i, j] = cov[j, i] = part[f"q{k}"].sum() / n - mean[i] * mean[j]
    return n, mean, cov


ESTIMATE = "gid long, start int, rows double, m array<double>, p array<double>, cov array<double>, logdet double"


def _row(gid: int, start: int, rows: float, mean: np.ndarray, cov: np.ndarray) -> dict:
    cov = floored(cov)
    return {"gid": gid, "start": start, "rows": rows, "m": mean.tolist(), "p": inverse(cov), "cov": cov.ravel().tolist(), "logdet": float(np.linalg.slogdet(cov)[1])}


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Quartiles and sums of groups to three first estimates each."""
    for pdf in batches:
        out = []
        for k in range(len(pdf)):
            part = pdf.iloc[k : k + 1]
            n, mean, cov = moments(part)
            quartiles = np.array([part[c].iat[0] for c in COORDS])
            middle, spread = quartiles[:, 1], (quartiles[:, 2] - quartiles[:, 0]) / 1.349
            for start, (m, c) in enumerate([(middle, np.diag(spread**2)), (mean, cov), (middle, np.zeros_like(cov))]):
                out.append(_row(int(part["gid"].iat[0]), start, n, m, c))
        if out:
            yield pd.DataFrame(out)


def _estimate(share: float, correct: bool):
    """applyInPandas: one group's binned sums to its next estimate."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        upto = pdf["n"].cumsum().to_numpy()
        last = int(np.searchsorted(upto, math.ceil(share * upto[-1])))
        n, mean, cov = moments(pdf.iloc[: last + 1])
        factor = consistency(n / upto[-1]) if correct else 1.0
        return pd.DataFrame([_row(int(pdf["gid"].iat[0]), int(pdf["start"].iat[0]), float(upto[-1]), mean, max(factor, 1.0) * cov)])

    return run


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest share of a normal sample
    that of the whole: share / P(chi2_6 <= q) with q the chi2_4 quantile of share."""
    if share >= 1 - 1e-9:
        return 1.0
    low, high = 0.0, 200.0
    for _ in range(80):
        q = (low + high) / 2
        if 1 - math.exp(-q / 2) * (1 + q / 2) < share:
            low = q
        else:
            high = q
    inner = 1 - math.exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2)
    return share / inner if inner > 0 else 1.0


def estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """(gid, rows, m, cov) of every group of rows (gid, x0..x3)."""
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{k}") for k, c in enumerate(COORDS)]]
    sums += [F.sum(F.col(COORDS[i]) * F.col(COORDS[j])).alias(f"q{k}") for k, (i, j) in enumerate(_pairs())]
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(c) for c in COORDS]
    now = save(rows.groupBy("gid").agg(*quartiles, *sums).mapInPandas(_starts, ESTIMATE).coalesce(1), "estimates")

    def concentrate(now: DataFrame, final: bool) -> DataFrame:
        binned = rows.join(now.select("gid", "start", "m", "p"), "gid").groupBy("gid", "start", bin_of(distance()).alias("bin")).agg(*sums)
        return save(binned.groupBy("gid", "start").applyInPandas(_estimate(share, final), ESTIMATE).coalesce(1), "estimates")

    last = None
    for _ in range(steps - 1):
        now, spent = concentrate(now, False), now
        drop(spent)
        total = now.agg(F.sum("logdet")).first()[0] or 0.0
        if last is not None and abs(last - total) < 1e-6 * max(1.0, abs(total)):
            break
        last = total
    least = now.groupBy("gid").agg(F.min_by(F.struct("start", "m", "p"), F.struct("logdet", "start")).alias("b")).select("gid", "b.*")
    return concentrate(least, True).select("gid", "rows", "m", "cov")


def pooled(rows: float, m: np.ndarray, c: np.ndarray, above_m: np.ndarray, above_c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A group's centre and covariance pooled with those above it."""
    own, w = rows / (rows + PRIOR), rows**3 / (rows**3 + CENTRE**3)
    return w * m + (1 - w) * above_m, own * c + (1 - own) * above_c + w * (1 - w) * np.outer(m - above_m, m - above_m)


def _shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Estimates of a group, its language and all rows to the one that judges it."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            mean = cov = None
            for rows, m, c in ((r.rows0, r.m0, r.cov0), (r.rows1, r.m1, r.cov1), (r.rows2, r.m2, r.cov2)):
                if m is None or c is None:
                    continue
                m, c = np.asarray(m), np.asarray(c).reshape(len(COORDS), -1)
                mean, cov = (m, c) if mean is None else pooled(rows, m, c, mean, cov)
            if mean is not None:
                out.append({"group": r.group, "m": mean.tolist(), "p": inverse(cov)})
        if out:
            yield pd.DataFrame(out)


def judges(rows: DataFrame) -> DataFrame:
    """(group, m, p) for every language and source of rows (level0..level2, failed,
    x0..x3): one row a group."""
    levels = [f"level{k}" for k in range(3)]
    fit = rows.filter(~F.col("failed")).select(F.explode(F.array(*levels)).alias("gid"), *COORDS)
    found = estimates(fit)
    out = rows.select(*levels).distinct()
    for k, level in enumerate(levels):
        own = found.select(F.col("gid").alias(level), F.col("rows").alias(f"rows{k}"), F.col("m").alias(f"m{k}"), F.col("cov").alias(f"cov{k}"))
        out = out.join(own, level, "left")
    out = out.withColumnRenamed("level2", "group").drop("level0", "level1")
    return save(out.mapInPandas(_shrink, "group long, m array<double>, p array<double>").coalesce(1), "judges")


def measured(counted: DataFrame, lang: str, source: str) -> DataFrame:
    """counted with failed, the group levels and the statistic vector."""
    levels = [group_id().alias("level0"), group_id(lang).alias("level1"), group_id(lang, source).alias("level2")]
    return counted.select("*", base_failed().alias("failed"), *levels, *coordinates())


def verdicts(rows: DataFrame, found: DataFrame, cutoff: float) -> DataFrame:
    """measured rows with base_failed, distance and kept, by their group's estimate."""
    judged = rows.join(found, F.col("level2") == F.col("group"), "left").withColumn("distance", distance())
    kept = ~F.col("failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return judged.withColumn("kept", kept).withColumnRenamed("failed", "base_failed").drop("group", "level0", "level1", "level2", "m", "p", *COORDS)


def judge(counted: DataFrame, lang: str, source: str, cutoff: float = CUTOFF) -> DataFrame:
    """counted with base_failed, distance and kept."""
    rows = save(measured(counted, lang, source), "statistics")
    return verdicts(rows, judges(rows), cutoff)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """(doc_id, counts, base_failed, distance, kept) for every row of docs."""
    columns = [F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")]
    judged = judge(count_texts(docs, columns), "lang", "source", **options)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """docs without rejected rows, with their columns. Estimates come from a first pass
    over the texts; a second one counts again and judges each row where it is, so
    no text is shuffled or written aside."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    held = docs.toDF(*names.values())
    of = [F.col(names[c]).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    first = save(measured(count_texts(held, of), "lang", "source").select("failed", "level0", "level1", "level2", *COORDS), "statistics")
    found = judges(first)
    again = held.select("*", *of[:2], counts_of(F.col(names[text_col]).cast("string")).alias("counts"))
    again = measured(again.select(*names.values(), "lang", "source", "counts.*"), "lang", "source")
    return verdicts(again, found, cutoff).filter("kept").select(*names.values()).toDF(*docs.columns)


def op1_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spread_documents(spark, sf_dir))
