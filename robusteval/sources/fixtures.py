"""Typed views of the test tables in the shapes the operators read.

Every view is a projection of one table (window keys are a user's events), so
it scales with its source and is never cached here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval.functions.keys import stable_seed
from robusteval.session import dealt, small_batches

#: method, mode, first event, forms, samples per form.
BLOCKS = [
    ("main", "thinking", 0, 5, 3),
    ("main", "non_thinking", 0, 5, 3),
    ("sc_8", "non_thinking", 15, 1, 8),
    ("scop_2x4", "non_thinking", 23, 2, 4),
    ("scop_4x2", "non_thinking", 31, 4, 2),
    ("scop_8x1", "non_thinking", 39, 8, 1),
]


#: Events of an item.
EACH = 47


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scored(spark: SparkSession, sf_dir: str, undecided: bool = False) -> DataFrame:
    """Scored generations from events; with undecided, some correctness is null. Every
    EACH events of a user are an item, and what is left over begins another."""
    k = F.get_json_object("props", "$.k").cast("long")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", k.alias("k"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    events = events.withColumn("place", place).select("*", (F.col("place") % EACH).alias("rn"), F.floor(F.col("place") / EACH).alias("part"))
    block = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(o).alias("mode"), F.lit(b).alias("base"), F.lit(f).alias("nf"), F.lit(s).alias("ns")) for m, o, b, f, s in BLOCKS])
    mine = F.filter(block, lambda x: (F.col("rn") >= x.base) & (F.col("rn") < x.base + x.nf * x.ns))
    rows = events.select("*", F.inline(mine))
    at = F.col("rn") - F.col("base")
    rows = rows.select(
        F.when(F.col("user_id") % 2 == 0, "gsm_symbolic").otherwise("math_500").alias("dataset"),
        F.concat(F.lit("u"), F.col("user_id"), F.when(F.col("part") > 0, F.concat(F.lit("-"), "part")).otherwise("")).alias("item_id"),
        "mode",
        "method",
        F.get(literal_array(C.FORM_IDS), F.floor(at / F.col("ns")).cast("int")).alias("form_id"),
        (at % F.col("ns")).cast("int").alias("sample_index"),
        "value",
        "k",
    )
    seed = F.when(F.col("method") == "main", F.get(literal_array(C.SAMPLING_SEEDS), F.col("sample_index")).cast("long")).otherwise(stable_seed(F.lit(C.RUN_SEED), "method", "item_id", "form_id", "sample_index"))
    width = F.when(F.col("mode") == "thinking", 60.0).otherwise(45.0)
    right = F.col("value") < width
    raw = right & (F.col("k") % 10 != 0)
    canon = F.when(F.col("k") != 50, right)
    return rows.select(
        "dataset",
        "item_id",
        "form_id",
        "mode",
        "method",
        "sample_index",
        seed.alias("seed"),
        F.when(F.col("value") < 250, F.floor(F.col("value") / width).cast("string")).alias("parsed_answer"),
        (F.when(F.col("k") != 50, right) if undecided else right).alias("correctness"),
        (-F.col("value") / 100).alias("normalized_log_probability"),
        (20 + F.col("k") % 7).alias("input_tokens"),
        (40 + F.col("k")).alias("output_tokens"),
        ((40 + F.col("k")) / 100).alias("gpu_seconds"),
        ((40 + F.col("k")) / 100).alias("latency_seconds"),
        (F.col("k") >= 97).alias("truncated"),
        F.when(F.col("k") >= 97, "length").otherwise("stop").alias("finish_reason"),
        (F.col("k") >= 5).alias("answer_format_ok"),
        raw.alias("raw_exact_match"),
        right.alias("normalized_match"),
        canon.alias("canonical_match"),
        (canon.isNull() | (raw != right)).alias("judge_required"),
        F.col("k").alias("marker"),
    )


def manifest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows (dataset, id, instance, question, answer) from part."""
    price = F.concat(F.lit("work\n#### "), F.format_string("%d,%03d", (F.col("p_partkey") % 9 + 1), F.col("p_partkey") % 1000))
    even = F.col("p_partkey") % 2 == 0
    return table(spark, sf_dir, "part").select(
        F.when(even, "gsm_symbolic").otherwise("math_500").alias("dataset"),
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 5).alias("instance"),
        F.col("p_name").alias("question"),
        F.when(even, price).otherwise(F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" "))).alias("answer"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their split, dealt by id: a tenth smoke, a fifth pilot."""
    from robusteval.functions.records import normalize_source

    rows = normalize_source(manifest_source(spark, sf_dir))
    part = F.col("source_index") % 10
    return rows.withColumn("split", F.when(part == 0, "smoke").when(part <= 2, "pilot").otherwise("confirmatory"))


def rewordings(spark: SparkSession, sf_dir: str, complete: bool = False) -> DataFrame:
    """Accepted rewordings of items: seven forms; unless complete one in eleven
    (item, form) is absent."""
    forms = F.array(*[F.struct(F.lit(f).alias("form_id"), F.lit(t).alias("transformation_type")) for f, t in C.FORMS[1:]])
    rows = manifest(spark, sf_dir).select("dataset", "item_id", "split", "source_index", "original_text", "canonical_answer", F.inline(forms))
    if not complete:
        rows = rows.filter(stable_seed("item_id", "form_id") % 11 != 0)
    text = F.concat_ws(" ", F.col("form_id"), F.when(F.col("form_id") != "voice", F.col("original_text")))
    return rows.select("*", text.alias("rewording_text"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text outputs in seven shapes from lineitem, with their answer."""
    q = F.col("l_quantity").cast("int").cast("string")
    money = F.concat(q, F.lit(",000.50"))
    shape = F.col("l_linenumber")
    text = (
        F.when(shape == 1, F.concat(F.lit("The total is \\boxed{ "), q, F.get(literal_array(["", "e0", ".5e1", "_0", "E+2"]), (F.col("l_suppkey") % 5).cast("int")), F.lit(" } as shown")))
        .when(shape == 2, F.concat(F.lit("First \\boxed{1} then \\Boxed {\\frac{"), q, F.lit("}{2}} end")))
        .when(shape == 3, F.concat(F.lit("step\nSo the Final answer is "), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("$"), money, F.lit("$"))).otherwise(q), F.lit(". \nbye")))
        .when(shape == 4, F.concat(F.lit("We use 12 and get "), q, F.lit("/"), F.col("l_linenumber").cast("string")))
        .when(shape == 5, F.concat(F.lit("bad \\boxed{"), q, F.lit("\nthe answer: "), q))
        .when(shape == 6, F.concat(F.lit("\\boxed{\\text{"), q, F.get(literal_array(["", ".5", ".0"]), (F.col("l_suppkey") % 3).cast("int")), F.lit("}%}")))
        .otherwise(F.lit("no number here"))
    )
    rows = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return rows.select(
        F.when(F.col("l_orderkey") % 2 == 0, "gsm_symbolic").otherwise("math_500").alias("dataset"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        q.alias("canonical_answer"),
        text.alias("raw_output"),
    )


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies by order: valid, uncertain, no JSON, wrong types; some twice
    (position is the order of arrival)."""
    kind = F.col("o_orderkey") % 4
    fine = F.col("o_orderkey") % 3 == 0
    text = (
        F.when(kind == 0, F.concat(F.lit('Sure: {"equivalent": '), F.when(fine, "true").otherwise("false"), F.lit(', "uncertain": false, "target_preserved": true, "no_added_hint": '), F.when(F.col("o_orderkey") % 8 == 0, "true").otherwise("false"), F.lit(', "reason": "r"} done')))
        .when(kind == 1, F.lit('{"equivalent": true,\n "uncertain": true, "target_preserved": true, "no_added_hint": true}'))
        .when(kind == 2, F.lit("I cannot say {not json}"))
        .otherwise(F.lit('{"equivalent": "yes", "uncertain": false}'))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    rows = dealt(orders).select(F.col("o_orderkey").alias("order_id"), text.alias("reply"), F.lit(0).alias("position"))
    again = orders.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("order_id"), F.lit('{"equivalent": true, "uncertain": false, "target_preserved": true, "no_added_hint": true}').alias("reply"), F.lit(1).alias("position"))
    return rows.unionByName(again)


def gate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents as original and rewording: (pair_id, original, rewording)."""
    small_batches(spark, 500)
    docs = table(spark, sf_dir, "documents")
    left = docs.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("original"))
    right = docs.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("rewording"))
    return left.join(right, "pair_id")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited pairs from labels: (audit_id, equivalence, transformation_label_correct)."""
    verdict = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "uncertain").when(F.col("quality") == 0, "not_equivalent").otherwise("equivalent")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("audit_id"), verdict.alias("equivalence"), F.when(F.col("doc_id") % 7 == 0, "no").otherwise("yes").alias("transformation_label_correct"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored logits from embeddings: (item, position, form_no, actual, logits); forms
    are rotations of the vector."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null")
    place = F.row_number().over(W.partitionBy("label", F.floor(F.col("vec_id") / 100)).orderBy("vec_id")).cast("long") - 1
    base = rows.select(
        F.concat(F.lit("t"), F.col("label"), F.lit("-"), F.floor(F.col("vec_id") / 100)).alias("item"),
        place.alias("position"),
        (F.col("vec_id") % 64).cast("int").alias("actual"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    forms = base.select("*", F.explode(literal_array([0, 1, 2])).alias("form_no"))
    shift = F.col("form_no") * 7
    rotated = F.when(shift == 0, F.col("v")).otherwise(F.concat(F.slice("v", shift + 1, 64 - shift), F.slice("v", F.lit(1), shift)))
    return forms.select("item", "position", "form_no", "actual", rotated.alias("logits"))
