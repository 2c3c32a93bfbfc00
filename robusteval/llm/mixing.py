"""Mixing sources to target weights by entropy balancing.

Rates r of documents solve

    minimise  sum_i s_i (r_i ln r_i - r_i)   subject to   sum_i s_i r_i f_ik = T_k

with s_i the document's words and f_ik its membership in cell k of a margin
(source; more margins may be given). The optimum is an exponential tilt,
r_i = exp(sum_k lambda_k f_ik), and lambda minimises the convex dual
sum_i s_i exp(lambda f_i) - lambda T. Newton steps damped by the dual itself
find it: every iteration is one aggregation of the rates' sums and cross sums
over the documents' cells (sufficient here, since the tilt is constant within a
cell), so what reaches the driver is a few numbers per cell, however many
documents there are.

Rates become copies without a random draw: a document gets floor(r) copies, and
for the remaining fraction documents are dealt by a hash of id, text and source into small
bins within classes of byte length of their source; a fold over the bins, longest
texts first, takes a bin exactly when that keeps the words taken nearest the
running target. The error left is about half of the last, smallest bin. Rows
that repeat an id, its text and its source are numbered first, so they fall into
bins of their own like any others; as rows of a key are alike, it doesn't matter
which of them has which number, on this run or another.

DataFrame functions only; no Python runs on the executors.

Defined results: a null or wordless text has size 0 (and, at size 0, any copies
take no words); a null source is a source of its own, last in order; a source
without words has target 0 and is left as it is; null and repeated ids are
told apart by their texts, and equal rows of one id by a number in any order, so
that the rows returned are the same on any run; extra columns pass through take_copies
and are ignored by mix; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from robusteval.llm.common import WORD, save, spread_documents

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BINS = 256


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[float], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of total by weight; a share stops at most times its size, and what
    it leaves is shared again by weight until none is above."""
    target = [0.0] * len(sizes)
    open_ = [k for k, s in enumerate(sizes) if s > 0]
    rest = total
    while open_:
        unit = rest / sum(weights[k] for k in open_)
        over = [k for k in open_ if unit * weights[k] > most * sizes[k]]
        if not over:
            for k in open_:
                target[k] = unit * weights[k]
            break
        for k in over:
            target[k] = most * sizes[k]
            rest -= target[k]
        open_ = [k for k in open_ if k not in set(over)]
    return target


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivoting, for the few unknowns of a Newton step."""
    n = len(right)
    a = [[*row, r] for row, r in zip(matrix, right)]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(a[r][c]))
        a[c], a[p] = a[p], a[c]
        for r in range(c + 1, n):
            if a[r][c]:
                f = a[r][c] / a[c][c]
                a[r] = [x - f * y for x, y in zip(a[r], a[c])]
    out = [0.0] * n
    for c in reversed(range(n)):
        out[c] = (a[c][n] - sum(a[c][k] * out[k] for k in range(c + 1, n))) / a[c][c]
    return out


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from rows of the driver, as a literal of the plan."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def entropy_balance(cells: DataFrame, margins: list[str], targets: dict[str, dict], tolerance: float = 1e-9, rounds: int = 60) -> dict[str, dict]:
    """Multipliers by margin and value. cells: one row for each combination of the
    margins' values, with its total of words in ``size``. targets: words asked of
    each value; a value without a target is not constrained. Every round is one
    aggregation of the tilted totals; with one margin the Hessian is diagonal."""
    names = [(m, v) for m in margins for v, t in targets[m].items() if t > 0]
    place = {x: k for k, x in enumerate(names)}
    want = [targets[m][v] for m, v in names]
    lam = [0.0] * len(names)

    def tilted(lam: list[float]) -> tuple[float, list[float], dict[tuple[int, int], float]]:
        out, power = cells, F.lit(0.0)
        for k, m in enumerate(margins):
            own = [(v, x) for (n, v), x in zip(names, lam) if n == m]
            table = local_table(cells.sparkSession, own, f"v{k} string, x{k} double")
            out = out.join(table, F.col(m).eqNullSafe(F.col(f"v{k}")), "left")
            power = power + F.coalesce(f"x{k}", F.lit(0.0))
        mass = F.sum(F.col("size") * F.exp(power)).alias("mass")
        total, sums, cross = 0.0, [0.0] * len(names), {}
        for r in out.groupBy(*margins).agg(mass).collect():
            total += r.mass
            here = [place[m, r[m]] for m in margins if (m, r[m]) in place]
            for a in here:
                sums[a] += r.mass
                for b in here:
                    cross[a, b] = cross.get((a, b), 0.0) + r.mass
        return total, sums, cross

    def dual(total: float, lam: list[float]) -> float:
        return total - sum(x * t for x, t in zip(lam, want))

    total, sums, cross = tilted(lam)
    for _ in range(rounds):
        if all(abs(s - t) <= tolerance * max(1.0, t) for s, t in zip(sums, want)):
            break
        right = [t - s for s, t in zip(sums, want)]
        if len(margins) == 1:
            step = [r / s for r, s in zip(right, sums)]
        else:
            ridge = 1e-9 * max(sums)
            step = solve([[cross.get((a, b), 0.0) + ridge * (a == b) for b in range(len(names))] for a in range(len(names))], right)
        scale, least = 1.0, dual(total, lam)
        while True:
            moved = [x + scale * d for x, d in zip(lam, step)]
            total, sums, cross = tilted(moved)
            if dual(total, moved) <= least + 1e-12 * abs(least) or scale < 1e-4:
                break
            scale /= 2
        lam = moved
    out: dict[str, dict] = {m: {} for m in margins}
    for (m, v), x in zip(names, lam):
        out[m][v] = x
    return out


def length_class(text: str) -> Column:
    return F.floor(F.log2(F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1)).cast("int")


def row_key(ident: str, text: str, source: str) -> Column:
    """A hash of what tells rows apart; a null is a value of its own."""
    values = [F.col(c).cast("string") for c in (ident, text, source)]
    return F.xxhash64(*[x for v in values for x in (F.isnull(v), F.coalesce(v, F.lit("")))])


def bin_no() -> Column:
    """The bin of a row (row_key, nth)."""
    return F.pmod(F.xxhash64("row_key", "nth"), F.lit(BINS)).cast("int")


#: Parts that rows of one key are numbered in.
PARTS = 64


def numbered(rows: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """rows with ``nth``: 0 if its row_key is not among the repeated ones, else 1 to n
    within the key, in any order. Only repeated rows are moved; they are numbered
    in parts, which then are offset, so that no task holds all rows of a key."""
    if repeats is None:
        return rows.withColumn("nth", F.lit(0).cast("long"))
    again = F.col("row_key") == F.col("again")
    single = rows.join(repeats, again, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")
    several = save(rows.join(repeats, again, "left_semi").withColumn("part", part), "repeated")
    per = several.groupBy("row_key", "part").agg(F.count("*").alias("n"))
    before = per.select("row_key", "part", (F.sum("n").over(W.partitionBy("row_key").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("row_key", "part").orderBy(F.lit(0)))
    several = several.withColumn("own", own).join(before, ["row_key", "part"]).withColumn("nth", F.col("own") + F.col("before"))
    return single.unionByName(several.select(*single.columns))


def repeated(rows: DataFrame) -> DataFrame | None:
    """The row keys that occur more than once, or nothing if none does."""
    found = save(rows.groupBy("row_key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("row_key").alias("again")), "repeats")
    return None if found.isEmpty() else found


def taken_bins(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """(of, class, bin): the bins of each source that get one copy more than
    floor(rate). sizes: (row_key, nth, class, source, size); sources: (of, rate)."""
    sums = sizes.groupBy("source", "class", bin_no().alias("bin")).agg(F.sum("size").alias("words"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("class")).alias("class"), "bin", "words")))
    per = sums.groupBy("source").agg(order.alias("list")).join(sources, F.col("source").eqNullSafe(F.col("of")))
    frac = F.col("rate") - F.floor("rate")
    none = F.array().cast("array<struct<class:int,bin:int>>")
    start = F.struct(F.lit(0.0).alias("due"), F.lit(0.0).alias("got"), none.alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        due = acc.due + frac * x.words
        take = acc.got + x.words / F.lit(2.0) <= due
        mine = F.array(F.struct((-x["class"]).alias("class"), x.bin.alias("bin")))
        got = acc.got + F.when(take, x.words.cast("double")).otherwise(0.0)
        return F.struct(due.alias("due"), got.alias("got"), F.when(take, F.concat(acc.taken, mine)).otherwise(acc.taken).alias("taken"))

    return per.filter(frac > 0).select("of", F.inline(F.aggregate("list", start, step, lambda a: a.taken)))


#: Up to so many sources the table of bins is at most 50 * 64 * 256 rows of three small columns.
FEW_SOURCES = 50


def with_copies(rows: DataFrame, sizes: DataFrame, source: str) -> DataFrame:
    """rows (row_key, nth, class, source and more) joined with their source's plan and
    ``copies``. sizes is the saved (row_key, nth, class, source, size) of the same
    rows."""
    sources = plan(sizes.select("source", "size"))
    few = sources.count() <= FEW_SOURCES
    near = F.broadcast if few else (lambda df: df)
    taken = taken_bins(sizes, sources.select("of", "rate"))
    taken = taken.select(F.col("of").alias("of_bin"), F.col("class").alias("bin_class"), F.col("bin").alias("bin_no"), F.lit(1).alias("extra"))
    out = rows.join(near(sources), F.col(source).eqNullSafe(F.col("of")))
    out = out.join(near(taken), F.col(source).eqNullSafe(F.col("of_bin")) & (F.col("class") == F.col("bin_class")) & (bin_no() == F.col("bin_no")), "left")
    return out.withColumn("copies", (F.floor("rate") + F.coalesce("extra", F.lit(0))).cast("int"))


def plan(sizes: DataFrame) -> DataFrame:
    """Per source: (of, source_size, target, rate), for rows (source, size).

    A source is a name in a mixing plan; their number is a setting of the mix,
    not of the corpus, and is checked.
    """
    spark = sizes.sparkSession
    cells = save(sizes.groupBy("source").agg(F.sum("size").alias("size")).repartition(1), "sources")
    rows = sorted(cells.limit(100_001).collect(), key=lambda r: (r.source is None, [ord(c) for c in r.source or ""]))
    if len(rows) > 100_000:
        raise ValueError("a mix is planned for at most 100,000 sources")
    total = [float(r["size"]) for r in rows]
    target = water_fill(total, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(rows))], SHARE * sum(total))
    lam = entropy_balance(cells, ["source"], {"source": {r.source: t for r, t in zip(rows, target)}})["source"] if rows else {}
    table = [(r.source, int(s), t, min(MOST, settled(math.exp(lam.get(r.source, 0.0))))) for r, s, t in zip(rows, total, target)]
    return local_table(spark, table, "of string, source_size long, target double, rate double")


def settled(rate: float) -> float:
    """A rate within the solver's tolerance of a whole number is that number."""
    return float(round(rate)) if abs(rate - round(rate)) < 1e-7 else rate


def measured(docs: DataFrame, ident: str, text: str, source: str) -> tuple[DataFrame, DataFrame | None]:
    """The saved narrow rows of docs, (ident, source, size, class, row_key, nth), and the
    row keys that repeat. Words are counted here and nowhere else."""
    rows = docs.select(F.col(ident).alias("ident"), F.col(source).cast("string").alias("source"), words_in(text).alias("size"), length_class(text).alias("class"), row_key(ident, text, source).alias("row_key"))
    rows = save(rows, "sizes")
    again = repeated(rows)
    return (numbered(rows, None) if again is None else save(numbered(rows, again), "sizes")), again


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs."""
    rows, _ = measured(docs, id_col, text_col, source_col)
    out = with_copies(rows, rows, "source")
    return out.select(F.col("ident").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def take_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: each row as often as its copies say."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    held = docs.toDF(*names.values())
    text, source, ident = names[text_col], names[source_col], names[id_col]
    sizes, again = measured(held, ident, text, source)
    rows = held.select("*", F.col(source).cast("string").alias("source"), length_class(text).alias("class"), row_key(ident, text, source).alias("row_key"))
    out = with_copies(numbered(rows, again), sizes, "source")
    out = out.filter("copies > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*names.values()).toDF(*docs.columns)


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spread_documents(spark, sf_dir))
