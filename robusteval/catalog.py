"""Registered queries of the evaluation operators, each with its DuckDB SQL.

A query takes (spark, sf_dir) and runs its operator over whole tables. Floating
results are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval import oracles as O
from robusteval.functions import algebra, answers, gates, keys, records
from robusteval.operators import adjudicate, budget, interventions, keysets, metrics, order, resample, stats
from robusteval.plans import intervening, requests
from robusteval.sources import files, fixtures
from robusteval.streaming import resume

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BY = metrics.BY
SAMPLE_KEY = ["dataset", "item_id", "form_id", "mode", "method", "sample_index"]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def main_rows(spark: SparkSession, sf: str, undecided: bool = False) -> DataFrame:
    return fixtures.scored(spark, sf, undecided).filter("method = 'main'")


def fixed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.scored(spark, sf).filter("method <> 'main'")


def found(spark: SparkSession, sf: str, complete: bool = True) -> DataFrame:
    return keysets.surfaces(fixtures.manifest(spark, sf), fixtures.rewordings(spark, sf, complete), "pilot")


# -- keys, digests, records ------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def fn_sha256(spark, sf):
    return fixtures.table(spark, sf, "documents").select("doc_id", keys.sha256_text("text").alias("digest"))


@query(f"SELECT l_orderkey, l_linenumber, {O._seed(f"'{C.RUN_SEED}'", 'l_orderkey::VARCHAR', 'l_linenumber::VARCHAR', 'l_returnflag')} AS seed FROM lineitem")
def fn_stable_seed(spark, sf):
    return fixtures.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", keys.stable_seed(F.lit(C.RUN_SEED), "l_orderkey", "l_linenumber", "l_returnflag").alias("seed"))


@query(
    """SELECT event_id, sha256('{"event":{"id":' || event_id || ',"type":' || to_json(event_type)::VARCHAR || '},"of":{"' || event_type || '":' || coalesce(to_json(value)::VARCHAR, 'null') || '},"user_id":' || user_id || ',"values":[' || coalesce(to_json(value)::VARCHAR, 'null') || ',null]}') AS fingerprint FROM events"""
)
def fn_canonical_json(spark, sf):
    """Nested rows: a struct, a map, an array with a number that is none."""
    rows = fixtures.table(spark, sf, "events")
    rows = rows.select("event_id", "user_id", F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id")).alias("event"), F.array(F.col("value").cast("double"), F.lit(float("nan"))).alias("values"), F.create_map("event_type", F.col("value").cast("double")).alias("of"))
    return rows.select("event_id", F.sha2(keys.canonical_row_json(rows, ["values", "user_id", "of", "event"]), 256).alias("fingerprint"))


@query(O.with_(O.MANIFEST) + "SELECT id, CASE WHEN dataset = 'gsm_symbolic' THEN canonical_answer ELSE replace(trim(answer), ',', '') END AS gold FROM src JOIN manifest m USING (dataset) WHERE m.source_index = src.id")
def fn_gsm_gold(spark, sf):
    return fixtures.manifest_source(spark, sf).select("id", records.gsm_gold("answer").alias("gold"))


@query(O.with_(O.MANIFEST) + "SELECT source_index, item_id FROM manifest")
def fn_item_id(spark, sf):
    return fixtures.manifest_source(spark, sf).select(F.col("id").alias("source_index"), records.item_id("dataset", ["id", "instance"], F.col("question")).alias("item_id"))


@query(O.with_(O.MANIFEST) + "SELECT dataset, item_id, source_index, source_revision, original_text, gold_answer, canonical_answer FROM manifest")
def prj_normalize_row(spark, sf):
    return records.normalize_source(fixtures.manifest_source(spark, sf))


@query(O.with_(O.SCORED) + "SELECT concat_ws('|', dataset, item_id, form_id, mode, seed::VARCHAR, method) AS record_key, count(*) AS n FROM scored GROUP BY 1")
def fn_record_key(spark, sf):
    rows = fixtures.scored(spark, sf).select(keys.record_key().alias("k"))
    return rows.select(F.concat_ws("|", *[F.col(f"k.{c}") for c in C.KEY]).alias("record_key")).groupBy("record_key").agg(F.count("*").alias("n"))


_PREFIX = C.CLEANED_PREFIXES
_DIRTY = f"CASE p_partkey % 6 WHEN 0 THEN ' {_PREFIX[0]} ' || p_name WHEN 1 THEN '{_PREFIX[1].upper()}' || p_name || ' ' WHEN 2 THEN '\"' || p_name || '\"' WHEN 3 THEN 'Rewritten problem: ''' || p_name || '''' WHEN 4 THEN '\"' ELSE p_name || '\"' END"


@query(
    f"""WITH d AS (SELECT p_partkey, trim({_DIRTY}) AS t FROM part),
a AS (SELECT p_partkey, CASE WHEN starts_with(lower(t), '{_PREFIX[0].lower()}') THEN trim(t[{len(_PREFIX[0]) + 1}:]) ELSE t END AS t FROM d),
b AS (SELECT p_partkey, CASE WHEN starts_with(lower(t), '{_PREFIX[1].lower()}') THEN trim(t[{len(_PREFIX[1]) + 1}:]) ELSE t END AS t FROM a),
c AS (SELECT p_partkey, CASE WHEN starts_with(lower(t), 'rewritten problem:') THEN trim(t[19:]) ELSE t END AS t FROM b)
SELECT p_partkey, CASE WHEN length(t) >= 2 AND t[1] = t[-1] AND t[1] IN ('"', '''') THEN trim(t[2:-2]) ELSE t END AS cleaned FROM c"""
)
def fn_clean_candidate(spark, sf):
    return fixtures.table(spark, sf, "part").select("p_partkey", records.clean_candidate(F.expr(_DIRTY_SPARK)).alias("cleaned"))


_DIRTY_SPARK = f"CASE p_partkey % 6 WHEN 0 THEN concat(' {_PREFIX[0]} ', p_name) WHEN 1 THEN concat('{_PREFIX[1].upper()}', p_name, ' ') WHEN 2 THEN concat('\"', p_name, '\"') WHEN 3 THEN concat('Rewritten problem: ', chr(39), p_name, chr(39)) WHEN 4 THEN '\"' ELSE concat(p_name, '\"') END"


def _sql_template(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, sql in values.items():
        out = out.replace("{" + name + "}", f"' || {sql} || '")
    return out


_INSTRUCTION_SQL = "CASE transformation_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.INSTRUCTIONS) + " END"


@query(O.with_(O.REWORDINGS) + f"SELECT item_id, form_id, sha256({_sql_template(C.GENERATION_PROMPT, type='transformation_type', instruction=_INSTRUCTION_SQL, original='original_text')}) AS prompt_hash FROM rewordings_all")
def fn_prompt_gen(spark, sf):
    rows = fixtures.rewordings(spark, sf, complete=True)
    return rows.select("item_id", "form_id", keys.sha256_text(records.generation_prompt("original_text", "transformation_type")).alias("prompt_hash"))


@query(O.with_(O.REWORDINGS) + f"SELECT item_id, form_id, {_sql_template(C.JUDGE_PROMPT, original='original_text', candidate='rewording_text')} AS prompt FROM rewordings_all")
def fn_prompt_judge(spark, sf):
    rows = fixtures.rewordings(spark, sf, complete=True)
    return rows.select("item_id", "form_id", records.judge_prompt("original_text", "rewording_text").alias("prompt"))


@query(O.with_(O.COMPLETIONS) + f"SELECT order_id, line_no, {_sql_template(C.BLINDED_PROMPT, gold='canonical_answer', response='raw_output')} AS prompt FROM completions")
def fn_prompt_blinded(spark, sf):
    return fixtures.completions(spark, sf).select("order_id", "line_no", records.blinded_prompt("canonical_answer", "raw_output").alias("prompt"))


_MODE_SQL = "CASE c_custkey % 3 WHEN 0 THEN 'thinking' WHEN 1 THEN 'non_thinking' ELSE 'reasoning' END"


@query(
    f"""WITH m AS (SELECT c_custkey, c_name, {_MODE_SQL} AS mode FROM customer)
SELECT c_custkey, mode, CASE WHEN mode = 'reasoning' THEN 'user:' || c_name || '{C.REASONING_SUFFIX}' ELSE 'system:{C.SYSTEM_PROMPT}|user:' || c_name END AS messages,
CASE WHEN mode <> 'reasoning' THEN mode = 'thinking' END AS enable_thinking FROM m"""
)
def fn_build_prompt(spark, sf):
    rows = fixtures.table(spark, sf, "customer").withColumn("mode", F.expr(_MODE_SQL))
    turns = F.array_join(F.transform(records.messages("c_name", "mode"), lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return rows.select("c_custkey", "mode", turns.alias("messages"), records.thinking_switch("mode").alias("enable_thinking"))


_SAMPLING_SQL = ", ".join(str(x) for x in C.SAMPLING)
_TOKENS_SQL = ", ".join(str(x) for x in C.MAX_TOKENS)


@query(
    f"""WITH m AS (SELECT c_custkey, {_MODE_SQL} AS mode, CASE WHEN c_custkey % 2 = 0 THEN 'practical' ELSE 'controlled' END AS protocol,
CASE WHEN c_custkey % 5 < 2 THEN 'gsm_symbolic' ELSE 'math_500' END AS dataset FROM customer),
s(mode, protocol, t, p, k, mp) AS (VALUES {_SAMPLING_SQL}), x(mode, dataset, n) AS (VALUES {_TOKENS_SQL})
SELECT c_custkey, mode, protocol, dataset, t::DOUBLE AS temperature, p::DOUBLE AS top_p, k::INTEGER AS top_k, mp::DOUBLE AS min_p, n::INTEGER AS max_tokens
FROM m JOIN s USING (mode, protocol) JOIN x USING (mode, dataset)"""
)
def fn_sampling(spark, sf):
    rows = fixtures.table(spark, sf, "customer").select("c_custkey", F.expr(_MODE_SQL).alias("mode"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'practical' ELSE 'controlled' END").alias("protocol"), F.expr("CASE WHEN c_custkey % 5 < 2 THEN 'gsm_symbolic' ELSE 'math_500' END").alias("dataset"))
    out = rows.withColumn("s", records.sampling("mode", "protocol"))
    return out.select("c_custkey", "mode", "protocol", "dataset", "s.temperature", "s.top_p", "s.top_k", "s.min_p", records.max_tokens("mode", "dataset").alias("max_tokens"))


_FOUR = ["equivalent", "uncertain", "target_preserved", "no_added_hint"]


@query(O.with_(O.REPLIES) + "SELECT order_id, position, ok4 AS parse_ok, " + ", ".join(f"CASE WHEN ok4 THEN (j->>'$.{f}')::BOOLEAN {'ELSE true ' if f == 'uncertain' else ''}END AS {f}" for f in _FOUR) + " FROM typed")
def fn_parse_judgment(spark, sf):
    return fixtures.judgments(spark, sf).select("order_id", "position", records.parse_reply("reply", _FOUR).alias("p")).select("order_id", "position", "p.*")


@query(O.with_(O.REPLIES) + "SELECT order_id, position, coalesce(ok4 AND (j->>'$.equivalent')::BOOLEAN AND NOT (j->>'$.uncertain')::BOOLEAN AND (j->>'$.target_preserved')::BOOLEAN AND (j->>'$.no_added_hint')::BOOLEAN, false) AS accepted FROM typed")
def gate_accept(spark, sf):
    return fixtures.judgments(spark, sf).select("order_id", "position", records.accepted(records.parse_reply("reply", _FOUR)).alias("accepted"))


_WORDS = lambda x: f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


@query(O.with_(O.REWORDINGS) + f"SELECT item_id, form_id, round({_WORDS('rewording_text')} / greatest(1, {_WORDS('original_text')}), 6) AS word_ratio FROM rewordings_all")
def fn_word_ratio(spark, sf):
    return r6(fixtures.rewordings(spark, sf, complete=True).select("item_id", "form_id", records.word_ratio("rewording_text", "original_text").alias("word_ratio")))


@query(f"SELECT c_custkey, regexp_full_match(CASE WHEN c_custkey % 3 = 0 THEN sha256(c_name)[1:40] WHEN c_custkey % 3 = 1 THEN 'main' ELSE upper(sha256(c_name)[1:40]) END, '{C.REVISION[1:-1]}') AS pinned FROM customer")
def meta_pin(spark, sf):
    digest = F.substring(F.sha2("c_name", 256), 1, 40)
    revision = F.when(F.col("c_custkey") % 3 == 0, digest).when(F.col("c_custkey") % 3 == 1, "main").otherwise(F.upper(digest))
    return fixtures.table(spark, sf, "customer").select("c_custkey", keys.immutable_revision(revision).alias("pinned"))


# -- answers ---------------------------------------------------------------------


@query(O.with_(O.COMPLETIONS) + "SELECT order_id, line_no, part_id, boxed AS body FROM parts")
def fn_extract_braced(spark, sf):
    rows = fixtures.completions(spark, sf).withColumn("pieces", F.split("raw_output", C.BOXED))
    rows = rows.withColumn("tail", F.when(F.size("pieces") > 1, answers.last_of(F.col("pieces"))))
    return rows.select("order_id", "line_no", "part_id", F.when(F.col("tail").isNotNull(), answers.braced("tail")).alias("body"))


@query(O.with_(O.COMPLETIONS) + "SELECT order_id, line_no, part_id, raw_extracted_answer, extraction_method FROM extracted")
def fn_extract_answer(spark, sf):
    return answers.extract(fixtures.completions(spark, sf)).select("order_id", "line_no", "part_id", "raw_extracted_answer", "extraction_method")


@query(O.with_(O.COMPLETIONS) + "SELECT order_id, line_no, part_id, parsed_answer FROM scored_text")
def fn_normalize_answer(spark, sf):
    rows = answers.extract(fixtures.completions(spark, sf))
    return rows.select("order_id", "line_no", "part_id", answers.normalize_answer("raw_extracted_answer").alias("parsed_answer"))


@query(O.with_(O.COMPLETIONS) + "SELECT order_id, line_no, part_id, canonical_match FROM fully")
def fn_equiv(spark, sf):
    rows = answers.extract(fixtures.completions(spark, sf))
    return rows.select("order_id", "line_no", "part_id", answers.equivalent_by_form(F.col("canonical_answer"), F.col("raw_extracted_answer")).alias("canonical_match"))


# The fixture's answers are numerals and fractions of them, so SQL can compare values.
_VALUE = """CASE WHEN contains(v, '/') THEN split_part(v, '/', 1)::DOUBLE / split_part(v, '/', 2)::DOUBLE WHEN contains(v, '%') THEN rtrim(v, '%')::DOUBLE / 100 ELSE replace(v, '_', '')::DOUBLE END = canonical_answer::DOUBLE"""


@query(
    O.with_(O.COMPLETIONS)
    + rf""", plainly AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw_extracted_answer, '\\(?:frac|text)', '', 'g'), '[}}]\s*[{{]', '/', 'g'), '[${{}},]', '', 'g') AS v FROM extracted),
valued AS (SELECT *, coalesce({_VALUE}, false) AS hit FROM plainly)
SELECT order_id, line_no, part_id, hit AS canonical_match, CASE WHEN hit OR raw_extracted_answer IS NULL THEN 'symbolic_full' ELSE 'symbolic_extracted' END AS parser_status FROM valued"""
)
def fn_equiv_symbolic(spark, sf):
    return algebra.score(fixtures.completions(spark, sf)).select("order_id", "line_no", "part_id", "canonical_match", "parser_status")


_SCORE = ["raw_extracted_answer", "parsed_answer", "raw_exact_match", "normalized_match", "canonical_match", "correctness", "answer_format_ok", "judge_required"]


@query(O.with_(O.COMPLETIONS) + f"SELECT order_id, line_no, part_id, {', '.join(_SCORE)}, 'fallback_normalized' AS parser_status, CASE WHEN judge_required THEN 'pending' ELSE 'not_required' END AS judge_status FROM judgeable")
def fn_score(spark, sf):
    return answers.score(fixtures.completions(spark, sf)).select("order_id", "line_no", "part_id", *_SCORE, "parser_status", "judge_status")


# -- gates on rewordings ---------------------------------------------------------

_PAIRS = "pairs AS (SELECT a.doc_id AS pair_id, a.text AS original, regexp_replace(regexp_replace(trim(b.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^\"+|\"+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"
_SYM = lambda x: f"list_sort(regexp_extract_all({x}, '(?:<=|>=|!=|==|[=<>±×÷+−*/^%])'))"
_UNIT = lambda x: f"list_sort(list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z]+(?:-[A-Za-z]+)?'), lambda w: lower(w)), lambda w: list_contains({O._list(C.UNITS)}, w)))"


@query()
def gate_numbers(spark, sf):
    """Rows only: RE2 has no look-behind, and a stand-in that consumes a character
    misses numbers that touch. Tested against the standard library instead."""
    return fixtures.gate_pairs(spark, sf).select("pair_id", (gates.numbers("original") == gates.numbers(gates.cleaned("rewording"))).alias("passed"))


@query("WITH " + _PAIRS + f" SELECT pair_id, {_SYM('original')} = {_SYM('clean')} AS passed FROM pairs")
def gate_symbols(spark, sf):
    return fixtures.gate_pairs(spark, sf).select("pair_id", (gates.symbols("original") == gates.symbols(gates.cleaned("rewording"))).alias("passed"))


@query("WITH " + _PAIRS + f" SELECT pair_id, {_UNIT('original')} = {_UNIT('clean')} AS passed FROM pairs")
def gate_units(spark, sf):
    return fixtures.gate_pairs(spark, sf).select("pair_id", (gates.units("original") == gates.units(gates.cleaned("rewording"))).alias("passed"))


@query()
def gate_edit(spark, sf):
    """Whole texts of neighbouring documents; matching blocks have no SQL form."""
    pairs = fixtures.gate_pairs(spark, sf)
    return r6(pairs.select("pair_id", gates.edit_distance("original", gates.cleaned("rewording")).alias("normalized_edit_distance")))


@query()
def gate_all(spark, sf):
    rows = fixtures.gate_pairs(spark, sf).withColumn("clean", gates.cleaned("rewording"))
    flags = gates.cheap_gates("original", "rewording")
    rows = rows.select("pair_id", *[x.alias(n) for n, x in flags.items()], gates.edit_distance("original", F.col("clean")).alias("d"))
    passed = F.col("d") >= C.MIN_EDIT_DISTANCE
    for name in flags:
        passed = passed & F.col(name)
    return rows.select("pair_id", *flags, F.round("d", 6).alias("normalized_edit_distance"), passed.alias("passed"))


# -- filters and guards ----------------------------------------------------------


@query(O.with_(O.MANIFEST) + "SELECT dataset, item_id, canonical_answer FROM manifest WHERE split = 'pilot'")
def flt_split(spark, sf):
    return fixtures.manifest(spark, sf).filter("split = 'pilot'").select("dataset", "item_id", "canonical_answer")


@query(O.with_(O.COMPLETIONS) + "SELECT order_id, line_no, part_id FROM judgeable WHERE judge_required AND order_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def flt_pending_judge(spark, sf):
    scored = answers.score(fixtures.completions(spark, sf))
    judged = fixtures.judgments(spark, sf).filter("order_id % 2 = 0").select("order_id").distinct()
    return adjudicate.queue(scored, judged, ["order_id"]).select("order_id", "line_no", "part_id")


@query(O.with_(O.SCORED) + "SELECT count(*) AS n_rows, count(*) FILTER (WHERE correctness IS NULL) AS n_undecided, count(*) > 0 AND count(*) = count(correctness) AS may_analyze FROM scored_open")
def flt_undecided_guard(spark, sf):
    return adjudicate.guard_decided(fixtures.scored(spark, sf, undecided=True))


@query(O.with_(O.SCORED, O.MAIN, O.LAYERS) + "SELECT dataset, mode, layer, count(*) AS n, count(*) FILTER (WHERE correctness) AS n_right FROM lay GROUP BY ALL")
def flt_decided_layer(spark, sf):
    rows = metrics.layers(main_rows(spark, sf))
    return rows.groupBy("dataset", "mode", "layer").agg(F.count("*").alias("n"), F.count_if("correctness").alias("n_right"))


@query(O.with_(O.MANIFEST) + "SELECT dataset, item_id, count(*) AS n FROM (SELECT dataset, item_id FROM manifest UNION ALL SELECT dataset, item_id FROM manifest WHERE source_index % 97 = 5) GROUP BY ALL HAVING count(*) > 1")
def chk_unique_ids(spark, sf):
    """One item in 97 is planted twice."""
    rows = fixtures.manifest(spark, sf)
    both = rows.unionByName(rows.filter("source_index % 97 = 5"))
    return both.groupBy("dataset", "item_id").agg(F.count("*").alias("n")).filter("n > 1")


# -- joins and key sets ----------------------------------------------------------

_KEY3 = ["dataset", "item_id", "form_id"]


@query(O.with_(O.REWORDINGS) + "SELECT dataset, item_id, form_id FROM rewordings_all WHERE split = 'pilot'")
def jn_expected_pairs(spark, sf):
    return keysets.expected_pairs(fixtures.manifest(spark, sf), C.FORM_IDS[1:], "pilot")


@query(O.with_(O.REWORDINGS) + f"SELECT f.dataset, f.item_id, form_no::INTEGER AS form_order, g.form_id, g.prompt_text FROM found f JOIN forms o ON form_no < {len(C.MAIN_FORMS)} LEFT JOIN found g ON g.dataset = f.dataset AND g.item_id = f.item_id AND g.form_id = o.form_id WHERE f.form_id = 'original'")
def jn_select_surfaces(spark, sf):
    return keysets.select_surfaces(found(spark, sf), C.MAIN_FORMS).select("dataset", "item_id", "form_order", "form_id", "prompt_text")


@query(O.with_(O.REWORDINGS) + "SELECT * FROM found_gaps")
def un_surface_lookup(spark, sf):
    return found(spark, sf, complete=False)


@query(O.with_(O.MANIFEST) + "SELECT dataset, item_id, unnest([1103, 2207, 3301])::BIGINT AS seed FROM manifest WHERE split = 'smoke'")
def jn_seed_expand(spark, sf):
    return requests.each_seed(fixtures.manifest(spark, sf).filter("split = 'smoke'"), "main").select("dataset", "item_id", "seed")


@query(O.with_(O.SCORED) + "SELECT dataset, item_id, form_id, mode, method, sample_index FROM scored ANTI JOIN (SELECT * FROM scored WHERE marker < 60) USING (dataset, item_id, form_id, mode, method, sample_index)")
def jn_resume_anti(spark, sf):
    rows = fixtures.scored(spark, sf)
    return keysets.pending(rows, rows.filter("marker < 60"), SAMPLE_KEY).select(*SAMPLE_KEY)


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.judgments(spark, sf).select("order_id", "position", records.parse_reply("reply", ["equivalent", "uncertain"]).alias("p")).select("order_id", "position", "p.*").filter("order_id % 3 <> 1")


@query(
    O.with_(O.COMPLETIONS, O.REPLIES)
    + """, latest AS (SELECT order_id, max(position) AS position FROM typed WHERE order_id % 3 <> 1 GROUP BY ALL),
last AS (SELECT order_id, ok2, (j->>'$.equivalent') AS e, (j->>'$.uncertain') AS u FROM typed JOIN latest USING (order_id, position))
SELECT s.order_id, line_no, part_id, CASE WHEN l.order_id IS NULL THEN correctness WHEN ok2 AND u = 'false' THEN e::BOOLEAN END AS correctness,
CASE WHEN l.order_id IS NULL THEN CASE WHEN judge_required THEN 'pending' ELSE 'not_required' END WHEN ok2 AND u = 'false' THEN 'decided' ELSE 'uncertain' END AS judge_status
FROM judgeable s LEFT JOIN last l ON l.order_id = s.order_id"""
)
def jn_apply_judgment(spark, sf):
    scored = answers.score(fixtures.completions(spark, sf))
    return adjudicate.apply_judgments(scored, _judged(spark, sf), ["order_id"]).select("order_id", "line_no", "part_id", "correctness", "judge_status")


@query(O.with_(O.REPLIES) + "SELECT order_id, max(position) AS position, arg_max(ok2, position) AS parse_ok FROM typed GROUP BY ALL")
def hp_judgments(spark, sf):
    rows = fixtures.judgments(spark, sf).select("order_id", "position", records.parse_reply("reply", ["equivalent", "uncertain"])["parse_ok"].alias("parse_ok"))
    return keysets.latest(rows, ["order_id"], "position")


@query(O.with_(O.SCORED) + "SELECT item_id, form_id, method, sample_index FROM scored WHERE method <> 'main' AND item_id IN (SELECT item_id FROM scored WHERE method = 'main' AND mode = 'thinking' AND form_id = 'original' AND correctness = false)")
def jn_semi_items(spark, sf):
    rows = fixtures.scored(spark, sf)
    items = rows.filter("method = 'main' and mode = 'thinking' and form_id = 'original' and not correctness").select("item_id")
    return rows.filter("method <> 'main'").join(items, "item_id", "left_semi").select("item_id", "form_id", "method", "sample_index")


_MAINF = [O.SCORED, O.MAIN, O.forms("main"), O.robust()]
_FIXEDI = [O.SCORED, O.FIXED, O.items("fixed")]


@query(O.with_(*_MAINF) + "SELECT a.dataset, a.item_id, a.robust AS left_value, b.robust AS right_value FROM fi a JOIN fi b USING (dataset, item_id) WHERE a.mode = 'thinking' AND b.mode = 'non_thinking'")
def jn_paired(spark, sf):
    items = metrics.item_robustness(metrics.item_forms(main_rows(spark, sf)))
    return stats.paired(items.filter("mode = 'thinking'"), items.filter("mode = 'non_thinking'"), ["dataset", "item_id"], "robust")


@query(O.with_(O.SCORED) + ", m AS (SELECT DISTINCT dataset, method FROM scored WHERE method <> 'main') SELECT a.dataset, a.method AS left_method, b.method AS right_method FROM m a JOIN m b ON a.dataset = b.dataset AND a.method < b.method")
def jn_method_pairs(spark, sf):
    m = fixed_rows(spark, sf).select("dataset", "method").distinct()
    a, b = (m.select("dataset", F.col("method").alias(f"{side}_method")) for side in ("left", "right"))
    return a.join(b, "dataset").filter("left_method < right_method")


@query(O.with_(O.SCORED) + "SELECT dataset, item_id, sum(output_tokens)::BIGINT AS cap FROM scored WHERE method = 'sc_8' GROUP BY ALL")
def jn_budget_ref(spark, sf):
    return budget.reference_budgets(fixtures.scored(spark, sf))


@query(O.with_(O.REWORDINGS) + "SELECT dataset, item_id, form_id FROM rewordings_all WHERE split = 'pilot' EXCEPT SELECT dataset, item_id, form_id FROM rewordings WHERE split = 'pilot'")
def set_missing(spark, sf):
    rows = fixtures.rewordings(spark, sf).filter("split = 'pilot'")
    return keysets.missing(keysets.expected_pairs(fixtures.manifest(spark, sf), C.FORM_IDS[1:], "pilot"), rows, _KEY3)


@query(O.with_(O.REWORDINGS) + f"SELECT dataset, item_id, form_id FROM rewordings WHERE split = 'pilot' EXCEPT SELECT dataset, item_id, form_id FROM rewordings_all WHERE split = 'pilot' AND form_id IN {tuple(C.FORM_IDS[1:5])}")
def set_unexpected(spark, sf):
    rows = fixtures.rewordings(spark, sf).filter("split = 'pilot'")
    return keysets.unexpected(keysets.expected_pairs(fixtures.manifest(spark, sf), C.FORM_IDS[1:5], "pilot"), rows, _KEY3)


@query("SELECT l_orderkey, l_linenumber, count(*) - 1 AS surplus FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def set_duplicates(spark, sf):
    return keysets.duplicates(fixtures.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, occurrence::INTEGER AS occurrence FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS occurrence FROM lineitem) WHERE occurrence > 1")
def hp_completed(spark, sf):
    return keysets.repeats(fixtures.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS surplus")
def set_surplus(spark, sf):
    return keysets.surplus(fixtures.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(O.with_(O.SCORED) + "SELECT mode, method, count(*) AS n FROM (SELECT mode, method FROM scored WHERE method = 'main' UNION ALL SELECT mode, method FROM scored WHERE method <> 'main') GROUP BY ALL")
def un_scores(spark, sf):
    rows = fixtures.scored(spark, sf)
    both = rows.filter("method = 'main'").unionByName(rows.filter("method <> 'main'"))
    return both.groupBy("mode", "method").agg(F.count("*").alias("n"))


# -- samples and plans -----------------------------------------------------------

_SPLITS = {"smoke": 5, "pilot": 40, "confirmatory": 200}
_HASH = lambda seed, *p: f"sha256(concat_ws(':', '{seed}', {', '.join(p)}))"


@query(
    O.with_(O.MANIFEST)
    + f""", o AS (SELECT dataset, item_id, row_number() OVER (PARTITION BY dataset ORDER BY {_HASH(C.SPLIT_SEED, 'dataset', 'item_id')}, item_id) AS r FROM manifest)
SELECT dataset, item_id, CASE WHEN r <= 5 THEN 'smoke' WHEN r <= 45 THEN 'pilot' ELSE 'confirmatory' END AS split FROM o WHERE r <= 245"""
)
def smp_splits(spark, sf):
    return requests.split_by_hash(records.normalize_source(fixtures.manifest_source(spark, sf)), _SPLITS).select("dataset", "item_id", "split")


@query(
    O.with_(O.MANIFEST)
    + f""", k AS (SELECT dataset, row_number() OVER (ORDER BY dataset) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT dataset FROM manifest)),
o AS (SELECT dataset, item_id, row_number() OVER (PARTITION BY dataset ORDER BY {_HASH(C.EXTERNAL_SEED, 'dataset', 'item_id')}, item_id) AS r FROM manifest)
SELECT dataset, item_id FROM o JOIN k USING (dataset) WHERE r <= 200 // k + (i < 200 % k)::INT"""
)
def smp_stratified(spark, sf):
    return requests.stratified(fixtures.manifest(spark, sf), 200)


@query(
    O.with_(O.REWORDINGS)
    + f""", chosen AS (SELECT dataset, item_id FROM found WHERE form_id = 'original' AND dataset = 'gsm_symbolic' ORDER BY {_HASH(C.RUN_SEED, 'item_id')}, item_id LIMIT 50)
SELECT dataset, item_id, string_agg(f.form_id || '=' || f.prompt_text, '|' ORDER BY form_no) AS texts FROM chosen JOIN found f USING (dataset, item_id) JOIN forms o ON o.form_id = f.form_id WHERE form_no < 3 GROUP BY ALL"""
)
def smp_ppcv(spark, sf):
    texts = found(spark, sf)
    items = requests.first_items(texts.filter("form_id = 'original' and dataset = 'gsm_symbolic'"), 50, C.RUN_SEED)
    out = requests.item_forms(texts, items, C.FORM_IDS[:3])
    return out.select("dataset", "item_id", F.array_join(F.transform("forms", lambda f: F.concat(f["form_id"], F.lit("="), f["prompt_text"])), "|").alias("texts"))


@query(
    O.with_(O.REWORDINGS)
    + f""", p AS (SELECT *, row_number() OVER (ORDER BY {_HASH(C.BOOTSTRAP_SEED, 'dataset', 'item_id', 'form_id')}, dataset, item_id, form_id) AS r, count(*) OVER () AS n FROM rewordings WHERE split = 'confirmatory')
SELECT dataset, item_id, form_id, transformation_type, 'audit-' || lpad(r::VARCHAR, 4, '0') AS audit_id FROM p WHERE r <= greatest(80, ceil(n * 10 / 100))"""
)
def smp_audit(spark, sf):
    return requests.audit_sample(fixtures.rewordings(spark, sf).filter("split = 'confirmatory'"))


@query(O.with_(O.REWORDINGS) + "SELECT dataset, item_id, form_id FROM (SELECT dataset, item_id, form_id FROM rewordings_all WHERE split = 'pilot' EXCEPT SELECT dataset, item_id, form_id FROM rewordings WHERE split = 'pilot') ORDER BY ALL LIMIT 25")
def lim_examples(spark, sf):
    return keysets.examples(set_missing(spark, sf), _KEY3)


_SORTED = O.with_(O.REWORDINGS) + "SELECT dataset, item_id, form_no::INTEGER AS form_order, forms.form_id FROM found JOIN forms USING (form_id) WHERE form_no < 5"


@query(_SORTED, "srt_plan_whole")
@query(_SORTED)
def srt_plan(spark, sf):
    rows = keysets.select_surfaces(found(spark, sf), C.MAIN_FORMS).select("dataset", "item_id", "form_order", "form_id")
    return rows.orderBy("dataset", "item_id", "form_order")


_PLANNED = "p AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 1024 ELSE 2048 END AS max_tokens FROM orders)"


@query("WITH " + _PLANNED + f" SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS batch FROM p")
def bat_batched(spark, sf):
    rows = fixtures.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return keysets.batched(rows, 4, ["o_orderkey"], ["o_custkey"])


@query("WITH " + _PLANNED + " SELECT max_tokens, count(*) AS n, min(o_orderkey) AS first_key FROM p GROUP BY ALL")
def grp_maxtokens(spark, sf):
    rows = fixtures.table(spark, sf, "orders").withColumn("max_tokens", F.when(F.col("o_custkey") % 2 == 0, 1024).otherwise(2048))
    return rows.groupBy("max_tokens").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


_PLAN = ["dataset", "item_id", "form_id", "prompt_text", "mode", "protocol", "seed", "method"]


@query(O.with_(O.REWORDINGS) + "SELECT dataset, item_id, form_id, prompt_text, 'thinking' AS mode, 'practical' AS protocol, unnest([1103, 2207, 3301])::BIGINT AS seed, 'main' AS method FROM found JOIN forms USING (form_id) WHERE form_no < 5")
def pl_main(spark, sf):
    return requests.main_plan(found(spark, sf), "thinking", "practical").select(*_PLAN)


_METHODS_SQL = ", ".join(f"('{m}', '{f}', {n})" for m, fs, n in C.METHODS for f in fs)


@query(
    O.with_(O.REWORDINGS)
    + f""", m(method, form_id, n) AS (VALUES {_METHODS_SQL}),
e AS (SELECT f.*, method, unnest(range(n))::INTEGER AS sample_index FROM found f JOIN m USING (form_id))
SELECT dataset, item_id, form_id, prompt_text, 'non_thinking' AS mode, 'practical' AS protocol, {O._seed(f"'{C.RUN_SEED}'", 'method', 'item_id', 'form_id', 'sample_index::VARCHAR')} AS seed, method, sample_index FROM e"""
)
def pl_scop(spark, sf):
    return requests.budget_plan(found(spark, sf), "non_thinking", "practical").select(*_PLAN, "sample_index")


@query(
    O.with_(O.REWORDINGS)
    + f""", k AS (SELECT dataset, row_number() OVER (ORDER BY dataset) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT dataset FROM found)),
o AS (SELECT dataset, item_id, row_number() OVER (PARTITION BY dataset ORDER BY {_HASH(C.EXTERNAL_SEED, 'dataset', 'item_id')}, item_id) AS r FROM found WHERE form_id = 'original'),
c AS (SELECT dataset, item_id FROM o JOIN k USING (dataset) WHERE r <= 200 // k + (i < 200 % k)::INT)
SELECT dataset, item_id, form_id, prompt_text, 'reasoning' AS mode, 'practical' AS protocol, unnest([1103, 2207, 3301])::BIGINT AS seed, 'external_main' AS method FROM found JOIN forms USING (form_id) SEMI JOIN c USING (dataset, item_id) WHERE form_no < 5"""
)
def pl_external(spark, sf):
    return requests.external_plan(found(spark, sf), 200, "reasoning", "practical").select(*_PLAN)


_LOCKED = "lk AS (SELECT dataset, split, item_id, row_number() OVER (PARTITION BY dataset, split ORDER BY item_id) - 1 AS pos, count(*) OVER (PARTITION BY dataset, split) AS n FROM manifest)"
_LEAF, _FAN = 8, 16


def _lock_level(k: int) -> str:
    return f"t{k} AS (SELECT dataset, split, part // {_FAN} AS part, sum(n)::BIGINT AS n, sha256(string_agg(digest, chr(10) ORDER BY part)) AS digest FROM t{k - 1} GROUP BY dataset, split, part // {_FAN})"


@query(O.with_(O.MANIFEST, _LOCKED) + "SELECT dataset, split, item_id, pos, n FROM lk")
def agg_lock_ids(spark, sf):
    """The frozen ids in order, a row each."""
    return order.ranked(fixtures.manifest(spark, sf).select("dataset", "split", "item_id"), ["dataset", "split"], ["item_id"])


@query(
    O.with_(O.MANIFEST, _LOCKED)
    + f""", t0 AS (SELECT dataset, split, pos // {_LEAF} AS part, count(*) AS n, sha256(string_agg(item_id, chr(10) ORDER BY item_id)) AS digest FROM lk GROUP BY dataset, split, pos // {_LEAF}),
{", ".join(_lock_level(k) for k in (1, 2, 3, 4))},
w AS (SELECT max(part) + 1 AS w FROM t0), h AS (SELECT CASE WHEN w <= 1 THEN 0 WHEN w <= {_FAN} THEN 1 WHEN w <= {_FAN**2} THEN 2 WHEN w <= {_FAN**3} THEN 3 ELSE 4 END AS h FROM w)
{" UNION ALL ".join(f"SELECT dataset, split, n, digest AS root FROM t{k} WHERE (SELECT h FROM h) = {k}" for k in range(5))}"""
)
def agg_lock(spark, sf):
    """Each frozen split's size and digest, from ranges of few ids so that there is a tree."""
    return requests.lock(fixtures.manifest(spark, sf), _LEAF, _FAN)


# -- votes, robustness, calibration, costs ---------------------------------------


@query(O.with_(O.SCORED) + "SELECT dataset, mode, method, count(*) AS n, count(DISTINCT item_id) AS n_items FROM scored GROUP BY ALL")
def agg_group(spark, sf):
    return fixtures.scored(spark, sf).groupBy(*BY).agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("n_items"))


@query(O.with_(O.SCORED, O.vote("scored_open", "dataset, mode, method, item_id")) + "SELECT dataset, mode, method, item_id, n, majority_answer, round(confidence, 6) AS confidence, majority_correct FROM maj")
def agg_majority(spark, sf):
    return r6(metrics.majority(fixtures.scored(spark, sf, undecided=True), [*BY, "item_id"]))


@query(O.with_(O.SCORED, O.MAIN_OPEN, O.forms("main")) + "SELECT dataset, mode, method, item_id, form_id, round(solve_rate, 6) AS solve_rate, round(run_variance, 6) AS run_variance, n, majority_answer, round(confidence, 6) AS confidence, majority_correct FROM f")
def agg_item_form(spark, sf):
    return r6(metrics.item_forms(main_rows(spark, sf, True)).drop("n_right", "n_decided"))


@query(O.with_(O.SCORED, O.MAIN_OPEN, O.forms("main"), O.robust()) + "SELECT dataset, mode, method, item_id, robust, round(worst_form_solve_rate, 6) AS worst_form_solve_rate, answer_flip, correctness_flip, round(mean_correctness, 6) AS mean_correctness, round(form_variance, 6) AS form_variance FROM fi")
def agg_robust(spark, sf):
    return r6(metrics.item_robustness(metrics.item_forms(main_rows(spark, sf, True))))


@query(O.with_(O.SCORED, O.MAIN_OPEN, O.main_metrics("main")) + f"SELECT {O.GROUP}, {O.rounded(O.MAIN_COLUMNS)} FROM fx")
def agg_main_metrics(spark, sf):
    return r6(metrics.main_metrics(main_rows(spark, sf, True)))


@query(O.with_(*_MAINF, O.variance()) + f"SELECT {O.GROUP}, {O.rounded(['v_run', 'v_form', 'v_item', 'pi_form'])} FROM fv")
def agg_variance(spark, sf):
    return r6(metrics.variance(metrics.item_forms(main_rows(spark, sf))))


@query(O.with_(O.SCORED, O.MAIN, O.LAYERS, O.main_metrics("lay", "f", "dataset, mode, method, layer")) + f"SELECT {O.GROUP}, layer, round(mean_accuracy, 6) AS accuracy, {O.rounded(['robust_accuracy', 'correctness_flip_rate', 'pi_form'])} FROM fx")
def agg_layers(spark, sf):
    return r6(metrics.layer_metrics(main_rows(spark, sf)))


@query(O.with_(*_FIXEDI) + "SELECT dataset, mode, method, item_id, round(entropy, 6) AS entropy FROM ie")
def agg_entropy(spark, sf):
    return r6(metrics.entropy(fixed_rows(spark, sf), [*BY, "item_id"]))


@query(O.with_(*_FIXEDI, O.calibration()) + O.BUDGET_SELECT)
def agg_fixed_budget(spark, sf):
    return r6(metrics.fixed_budget(fixed_rows(spark, sf)))


def _calibration(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.calibration_rows(metrics.item_votes(fixed_rows(spark, sf)))


_CAL = O.with_(*_FIXEDI, O.calibration())


@query(_CAL + f"SELECT {O.GROUP}, round(brier_score, 6) AS brier_score FROM xb")
def agg_brier(spark, sf):
    return r6(metrics.brier(_calibration(spark, sf)))


@query(_CAL + f"SELECT {O.GROUP}, round(ece_fixed, 6) AS ece_fixed FROM xf")
def agg_ece_fixed(spark, sf):
    return r6(metrics.ece_fixed(_calibration(spark, sf)))


@query(_CAL + f"SELECT {O.GROUP}, round(ece_adaptive, 6) AS ece_adaptive FROM xa")
def agg_ece_adaptive(spark, sf):
    return r6(metrics.ece_adaptive(_calibration(spark, sf)))


@query(_CAL + f"SELECT {O.GROUP}, round(auroc_disagreement, 6) AS auroc_disagreement, round(auroc_entropy, 6) AS auroc_entropy FROM xd JOIN xe USING ({O.GROUP})")
def agg_auroc(spark, sf):
    cal = _calibration(spark, sf)
    return r6(metrics.auroc(cal, BY, 1 - F.col("c"), "auroc_disagreement").join(metrics.auroc(cal, BY, F.col("entropy"), "auroc_entropy"), BY))


_COST_SQL = """SELECT dataset, mode, method, count(*) AS n_rows, count(DISTINCT item_id) AS n_items, sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens, round(sum(gpu_seconds), 6) AS total_gpu_seconds,
round(avg(raw_exact_match::INT), 6) AS raw_exact_accuracy, round(avg(normalized_match::INT), 6) AS normalized_parser_accuracy, round(avg(canonical_match::INT), 6) AS symbolic_pre_judge_accuracy, round(avg(judge_required::INT), 6) AS judge_adjudication_rate,
round(1 - avg(answer_format_ok::INT), 6) AS answer_format_violation_rate, round(avg(truncated::INT), 6) AS truncation_rate, round(avg((finish_reason NOT IN ('stop', 'length'))::INT), 6) AS generation_failure_rate,
round(sum(input_tokens) / count(DISTINCT item_id), 6) AS mean_input_tokens_per_item, round(sum(output_tokens) / count(DISTINCT item_id), 6) AS mean_output_tokens_per_item, round(sum(gpu_seconds) / count(DISTINCT item_id), 6) AS mean_gpu_seconds_per_item FROM scored GROUP BY ALL"""


@query(O.with_(O.SCORED) + _COST_SQL)
def agg_costs(spark, sf):
    return r6(metrics.costs(fixtures.scored(spark, sf)).drop("peak_gpu_memory_gib"))


@query(O.with_(O.SCORED) + ", l AS (SELECT dataset, mode, method, item_id, sum(latency_seconds) AS s FROM scored GROUP BY ALL) SELECT dataset, mode, method, round(avg(s), 6) AS mean_latency_seconds_per_item, round(quantile_cont(s, 0.95), 6) AS p95_latency_seconds_per_item FROM l GROUP BY ALL")
def agg_latency(spark, sf):
    return r6(metrics.latency(fixtures.scored(spark, sf)))


@query(
    O.with_(O.SCORED, O.MAIN, O.main_metrics("main"))
    + """SELECT dataset, mode, method, round(mean_accuracy * 1000000 / (t / n), 6) AS accuracy_per_million_generated_tokens, round(mean_accuracy * 3600 / (g / n), 6) AS accuracy_per_gpu_hour, round(robust_accuracy * 3600 / (g / n), 6) AS robust_accuracy_per_gpu_hour
FROM fx JOIN (SELECT dataset, mode, method, sum(output_tokens) AS t, sum(gpu_seconds) AS g, count(DISTINCT item_id) AS n FROM main GROUP BY ALL) USING (dataset, mode, method)"""
)
def fn_rate_cost(spark, sf):
    rows = main_rows(spark, sf)
    accuracy = metrics.main_metrics(rows).withColumnRenamed("mean_accuracy", "accuracy")
    return r6(metrics.efficiency(accuracy.select(*BY, "accuracy", "robust_accuracy"), metrics.costs(rows)))


@query(O.with_(O.REWORDINGS) + f"SELECT transformation_type, round(avg({_WORDS('rewording_text')} / greatest(1, {_WORDS('original_text')})), 6) AS mean_ratio, avg({_WORDS('rewording_text')} / greatest(1, {_WORDS('original_text')})) < 0.85 AS below FROM rewordings GROUP BY ALL")
def agg_word_ratio(spark, sf):
    return r6(adjudicate.word_ratios(fixtures.rewordings(spark, sf), records.word_ratio("rewording_text", "original_text")))


_AUDIT = "a AS (SELECT doc_id AS audit_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'uncertain' WHEN quality = 0 THEN 'not_equivalent' ELSE 'equivalent' END AS e FROM labels), n AS (SELECT count(*) AS t, count(*) FILTER (WHERE e <> 'uncertain') AS d, count(*) FILTER (WHERE e = 'equivalent') AS s, count(*) FILTER (WHERE e = 'uncertain') AS u FROM a)"
_WILSON = lambda s, n: (
    f"CASE WHEN {n} = 0 THEN 0 ELSE greatest(0, ({s} / {n} + {C.Z95} ** 2 / (2 * {n}) - {C.Z95} * sqrt({s} / {n} * (1 - {s} / {n}) / {n} + {C.Z95} ** 2 / (4 * {n} * {n}))) / (1 + {C.Z95} ** 2 / {n})) END",
    f"CASE WHEN {n} = 0 THEN 0 ELSE least(1, ({s} / {n} + {C.Z95} ** 2 / (2 * {n}) + {C.Z95} * sqrt({s} / {n} * (1 - {s} / {n}) / {n} + {C.Z95} ** 2 / (4 * {n} * {n}))) / (1 + {C.Z95} ** 2 / {n})) END",
)
_W = _WILSON("s", "d")


@query(f"WITH {_AUDIT} SELECT t AS audited_pairs, d AS decided_pairs, s AS equivalent_pairs, u AS uncertain_pairs, 0::BIGINT AS invalid_rows, round(s / d, 6) AS equivalence_rate, round({_W[0]}, 6) AS wilson_low, round({_W[1]}, 6) AS wilson_high, s / d >= 0.95 AND u = 0 AS passed FROM n")
def agg_audit(spark, sf):
    return r6(adjudicate.audit_report(fixtures.audit(spark, sf)))


_W2 = _WILSON("s", "n")


@query(O.with_(O.SCORED) + f", w AS (SELECT item_id, count(*) FILTER (WHERE correctness) AS s, count(*) AS n FROM scored GROUP BY ALL) SELECT item_id, s AS successes, n AS total, round({_W2[0]}, 6) AS low, round({_W2[1]}, 6) AS high FROM w")
def st_wilson(spark, sf):
    rows = fixtures.scored(spark, sf).groupBy("item_id").agg(F.count_if("correctness").alias("successes"), F.count("*").alias("total"))
    low, high = stats.wilson(F.col("successes"), F.col("total"))
    return r6(rows.select("item_id", "successes", "total", low.alias("low"), high.alias("high")))


@query(O.with_(O.SCORED) + "SELECT mode, method, round(avg(output_tokens), 6) AS mean_output_tokens, round(sum(output_tokens) / sum(gpu_seconds), 6) AS tokens_per_second, floor(20160.0::DOUBLE * (sum(output_tokens) / sum(gpu_seconds)) / (avg(output_tokens) * 15))::BIGINT AS n_max FROM scored GROUP BY ALL")
def agg_throughput(spark, sf):
    return r6(metrics.throughput(fixtures.scored(spark, sf), 15, ["mode", "method"]))


@query(
    O.with_(*_FIXEDI, O.calibration())
    + """, p AS (SELECT dataset, method, round(final_accuracy, 6) AS accuracy, round(mean_output_tokens_per_item, 6) AS tokens FROM xz)
SELECT dataset, method, accuracy, tokens, NOT EXISTS (SELECT 1 FROM p q WHERE q.dataset = p.dataset AND q.tokens <= p.tokens AND q.accuracy >= p.accuracy AND (q.tokens < p.tokens OR q.accuracy > p.accuracy)) AS on_frontier FROM p"""
)
def win_pareto(spark, sf):
    points = metrics.item_votes(fixed_rows(spark, sf)).filter("majority_correct is not null")
    points = points.groupBy("dataset", "method").agg(F.round(F.avg(metrics.number("majority_correct")), 6).alias("accuracy"), F.round(F.avg("output_tokens"), 6).alias("tokens"))
    return metrics.pareto(points, by=["dataset"])


# -- budgets, tests, resampling --------------------------------------------------


@query(O.with_(O.SCORED, O.FIXED, O.MATCHED) + "SELECT dataset, item_id, mode, method, form_id, sample_index, seed, t AS output_tokens FROM picks")
def win_token_match(spark, sf):
    return budget.token_match(fixtures.scored(spark, sf)).select("dataset", "item_id", "mode", "method", "form_id", "sample_index", "seed", "output_tokens")


@query(O.with_(O.SCORED, O.FIXED, O.MATCHED) + ", matched AS (SELECT s.* FROM scored s JOIN picks p USING (dataset, item_id, mode, method, form_id, sample_index, seed)),\n" + O.items("matched").strip() + ",\n" + O.calibration().strip() + " " + O.BUDGET_SELECT)
def agg_token_matched(spark, sf):
    return r6(metrics.fixed_budget(budget.token_match(fixtures.scored(spark, sf))))


_COMPARE_MODES = f"pm AS (SELECT a.dataset || ': thinking vs non_thinking robust correctness' AS comparison, count(*) AS n, count(*) FILTER (WHERE a.robust AND NOT b.robust) AS left_only, count(*) FILTER (WHERE NOT a.robust AND b.robust) AS right_only FROM fi a JOIN fi b USING (dataset, item_id) WHERE a.mode = 'thinking' AND b.mode = 'non_thinking' GROUP BY a.dataset)"
_COMPARE_METHODS = "pn AS (SELECT a.dataset || ': ' || a.method || ' vs ' || b.method || ' final correctness' AS comparison, count(*) AS n, count(*) FILTER (WHERE a.majority_correct AND NOT b.majority_correct) AS left_only, count(*) FILTER (WHERE NOT a.majority_correct AND b.majority_correct) AS right_only FROM it a JOIN it b ON a.dataset = b.dataset AND a.item_id = b.item_id AND a.method < b.method WHERE a.majority_correct IS NOT NULL AND b.majority_correct IS NOT NULL GROUP BY a.dataset, a.method, b.method)"
_TESTED = lambda src: f"SELECT comparison, n, left_only, right_only, round({O.mcnemar('left_only', 'right_only')}, 6) AS pvalue, round((left_only - right_only) / n, 6) AS effect FROM {src}"


@query(O.with_(*_MAINF, _COMPARE_MODES) + _TESTED("pm"))
def st_compare_modes(spark, sf):
    return r6(stats.compare_modes(metrics.item_robustness(metrics.item_forms(main_rows(spark, sf)))))


@query(O.with_(*_FIXEDI, _COMPARE_METHODS) + _TESTED("pn"))
def st_compare_methods(spark, sf):
    return r6(stats.compare_methods(metrics.item_votes(fixed_rows(spark, sf))))


@query(
    O.with_(O.SCORED, O.MAIN, O.forms("main"), O.robust(), O.FIXED, O.items("fixed"), _COMPARE_MODES, _COMPARE_METHODS)
    + f""", t AS (SELECT comparison, {O.mcnemar('left_only', 'right_only')} AS p FROM (SELECT * FROM pm UNION ALL SELECT * FROM pn)),
o AS (SELECT *, row_number() OVER (ORDER BY p) - 1 AS r, count(*) OVER () AS m FROM t)
SELECT comparison, round(p, 6) AS pvalue, round(max(least(1.0, (m - r) * p)) OVER (ORDER BY r), 6) AS holm_adjusted_pvalue FROM o"""
)
def win_holm(spark, sf):
    modes = stats.compare_modes(metrics.item_robustness(metrics.item_forms(main_rows(spark, sf))))
    methods = stats.compare_methods(metrics.item_votes(fixed_rows(spark, sf)))
    return r6(stats.holm(modes.unionByName(methods)).select("comparison", "pvalue", "holm_adjusted_pvalue"))


@query("WITH d AS (SELECT p_partkey, p_partkey % 40 AS b, p_partkey % 23 AS c FROM part) SELECT p_partkey, b, c, round(" + O.mcnemar("b", "c") + ", 6) AS pvalue FROM d")
def st_mcnemar(spark, sf):
    rows = fixtures.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("b"), (F.col("p_partkey") % 23).alias("c"))
    return r6(rows.select("*", stats.binomial_p(F.col("b"), F.col("c")).alias("pvalue")))


_MIX = lambda x: f"xor(({x}) >> 16, ({x}))"


def _hashed(src: str, x: str, out: str) -> str:
    """src with out, the 32-bit hash of x."""
    for k in (1, 2):
        src = f"(SELECT * EXCLUDE ({'__y' if k == 1 else '__z'}), ({_MIX('__y' if k == 1 else '__z')} * {resample.MULTIPLIER}) & 4294967295 AS {'__z' if k == 1 else '__w'} FROM " + (f"(SELECT *, ({x}) & 4294967295 AS __y FROM {src})" if k == 1 else src) + ")"
    return f"(SELECT * EXCLUDE (__w), {_MIX('__w')} AS {out} FROM {src})"


def _drawn(src: str, by: str, item: str) -> str:
    """Items drawn with replacement, one row each: groups of one block, which is where
    picks begin; larger groups are tested against the same weights in numpy."""
    group = f"(SELECT {by}, count(*) AS n FROM {src} GROUP BY ALL)"
    draws = f"(SELECT *, unnest(range({C.BOOTSTRAP_RESAMPLES})) AS draw FROM " + _hashed(group, str(C.BOOTSTRAP_SEED), "h0") + ")"
    slots = f"(SELECT * EXCLUDE (h0, h1), unnest(range(n)) AS slot FROM " + _hashed(_hashed(draws, "h0 + draw", "h1"), "h1 + 0", "h2") + ")"
    return f"""
num AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {item}) - 1 AS pos FROM {src}),
drawn AS (SELECT num.*, draw FROM (SELECT {by}, draw, h3 % n AS pos FROM {_hashed(slots, 'h2 + slot', 'h3')}) JOIN num USING ({by}, pos))"""


#: Shares of few items end in a 5 at the seventh place, where rounding would turn on the last bit.
_PLACES = 10
_Q = lambda c: f"round(quantile_cont({c}, 0.025), {_PLACES}) AS {c}_low, round(quantile_cont({c}, 0.975), {_PLACES}) AS {c}_high"
_BOOT_MEAN = O.with_(*_MAINF, _drawn("fi", O.GROUP, "item_id")) + f", e AS (SELECT {O.GROUP}, draw, avg(mean_correctness) AS mean FROM drawn GROUP BY ALL) SELECT {O.GROUP}, {_Q('mean')} FROM e GROUP BY ALL"
_BOOT_VARIANCE = (
    O.with_(*_MAINF, f"iv AS (SELECT {O.GROUP}, item_id, avg(run_variance) AS run, var_pop(solve_rate) AS form, avg(solve_rate) AS item_mean FROM f GROUP BY ALL)", _drawn("iv", O.GROUP, "item_id"))
    + f""", e AS (SELECT {O.GROUP}, draw, avg(run) AS v_run, avg(form) AS v_form, var_pop(item_mean) AS v_item FROM drawn GROUP BY ALL),
g AS (SELECT *, CASE WHEN v_run + v_form + v_item > 0 THEN v_form / (v_run + v_form + v_item) ELSE 0 END AS pi_form FROM e)
SELECT {O.GROUP}, {_Q('v_run')}, {_Q('v_form')}, {_Q('v_item')}, {_Q('pi_form')} FROM g GROUP BY ALL"""
)
_BOOT_PAIRED = (
    O.with_(*_MAINF, "df AS (SELECT a.dataset, a.item_id, (a.robust::INT - b.robust::INT)::DOUBLE AS d FROM fi a JOIN fi b USING (dataset, item_id) WHERE a.mode = 'thinking' AND b.mode = 'non_thinking')", _drawn("df", "dataset", "item_id"))
    + f", e AS (SELECT dataset, draw, avg(d) AS mean FROM drawn GROUP BY ALL) SELECT dataset, round(any_value(effect), {_PLACES}) AS effect, {_Q('mean')} FROM e JOIN (SELECT dataset, avg(d) AS effect FROM df GROUP BY ALL) USING (dataset) GROUP BY dataset"
)


@query(_BOOT_MEAN, "st_bootstrap_full")
@query(_BOOT_MEAN)
def st_bootstrap(spark, sf):
    items = metrics.item_robustness(metrics.item_forms(main_rows(spark, sf)))
    return r6(resample.mean(items, BY, "item_id", "mean_correctness"), _PLACES)


@query(_BOOT_VARIANCE, "st_boot_variance_full")
@query(_BOOT_VARIANCE)
def st_boot_variance(spark, sf):
    return r6(resample.variance(stats.item_variances(metrics.item_forms(main_rows(spark, sf)), BY), BY), _PLACES)


@query(_BOOT_PAIRED, "st_paired_diff_full")
@query(_BOOT_PAIRED)
def st_paired_diff(spark, sf):
    pairs = jn_paired(spark, sf).select("dataset", "item_id", (metrics.number("left_value") - metrics.number("right_value")).alias("d"))
    effect = pairs.groupBy("dataset").agg(F.avg("d").alias("effect"))
    return r6(effect.join(resample.mean(pairs, ["dataset"], "item_id", "d"), "dataset"), _PLACES)


# -- interventions ---------------------------------------------------------------

_TRAJ = """
t0 AS (SELECT 't' || label || '-' || (vec_id // 100) AS item, row_number() OVER (PARTITION BY label, vec_id // 100 ORDER BY vec_id) - 1 AS position, (vec_id % 64)::INTEGER AS actual, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
tr AS (SELECT item, position, actual, k AS form_no, list_concat(v[1 + k * 7:64], v[1:k * 7]) AS logits FROM t0, (VALUES (0), (1), (2)) s(k)),
ds AS (SELECT *, (1 - exp(logits[actual + 1] - list_max(logits))) / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))) AS d FROM tr),
ps AS (SELECT item, position, max(round(d, 9)) AS score FROM ds GROUP BY ALL),
top AS (SELECT item, position, actual, (list_sort(list_transform(range(1, 65), lambda i: {'x': -logits[i], 'i': i - 1})))[1:20] AS s FROM tr WHERE form_no = 0),
cr AS (SELECT item, position AS critical_position, score AS critical_score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, position) AS r FROM ps) WHERE r = 1),
cd AS (SELECT item, position, actual, list_concat([actual::BIGINT], list_filter(list_transform(s, lambda p: p.i), lambda i: i <> actual))[1:11] AS candidates FROM top)"""


@query("WITH " + _TRAJ.strip() + " SELECT item, position, form_no, round(d, 6) AS discrepancy FROM ds")
def pp_discrepancy(spark, sf):
    rows = fixtures.trajectories(spark, sf)
    return r6(rows.select("item", "position", "form_no", interventions.discrepancy("logits", "actual").alias("discrepancy")))


@query("WITH " + _TRAJ.strip() + " SELECT item, critical_position, round(critical_score, 6) AS critical_score FROM cr")
def pp_critical(spark, sf):
    return r6(interventions.critical(interventions.position_scores(fixtures.trajectories(spark, sf))))


@query("WITH " + _TRAJ.strip() + " SELECT item, position, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, position) AS r FROM (SELECT item, position, round(score, 6) AS score FROM ps)) WHERE r = 1")
def win_first_max(spark, sf):
    scores = r6(interventions.position_scores(fixtures.trajectories(spark, sf)))
    return interventions.first_by(scores, ["item"], F.desc("score"), "position")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.trajectories(spark, sf).filter("form_no = 0")
    return rows.select("item", "position", "actual", interventions.candidates("actual", interventions.top_tokens("logits", 20), 11).alias("candidates"))


@query("WITH " + _TRAJ.strip() + " SELECT item, position, actual, array_to_string(candidates, ',') AS candidates FROM cd")
def pp_candidates(spark, sf):
    return _candidates(spark, sf).withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@query("WITH " + _TRAJ.strip() + ", g AS (SELECT item, position, actual, unnest(range(len(candidates)))::INTEGER AS candidate_index, candidates FROM cd) SELECT item, position, actual, candidate_index, candidates[candidate_index + 1]::INTEGER AS candidate_token, k::INTEGER AS form_index, f AS form_id FROM g, (VALUES (0, 'original'), (1, 'lexical'), (2, 'syntactic')) x(k, f)")
def pp_rollout_grid(spark, sf):
    return interventions.rollout_grid(_candidates(spark, sf), C.FORM_IDS[:3])


_SIM = "w AS (SELECT 'l' || label AS item, vec_id, 'v' || vec_id AS form_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1 AS o FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL), sm AS (SELECT a.item, a.form_id, a.vec_id, CASE WHEN a.o THEN 1.0 ELSE greatest(0, list_cosine_similarity(a.v, b.v)) END AS weight FROM w a JOIN w b ON a.item = b.item AND b.o)"


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a label as an item's forms; the lowest id is the original."""
    rows = fixtures.table(spark, sf, "embeddings").filter("embedding is not null and label is not null")
    first = rows.groupBy("label").agg(F.min("vec_id").alias("first_id"))
    rows = rows.join(first, "label")
    return interventions.similarity(rows.select(F.concat(F.lit("l"), "label").alias("item"), F.concat(F.lit("v"), "vec_id").alias("form_id"), (F.col("vec_id") == F.col("first_id")).alias("is_original"), F.col("embedding").cast("array<double>").alias("v")))


@query(f"WITH {_SIM} SELECT item, form_id, round(weight, 6) AS weight FROM sm")
def pp_weights(spark, sf):
    return r6(_weights(spark, sf))


@query(
    f"""WITH {_SIM}, ro AS (SELECT item, vec_id AS i, CASE WHEN vec_id % 11 <> 0 THEN (vec_id % 5)::VARCHAR END AS a, weight FROM sm),
g AS (SELECT item, a, CASE WHEN a IS NULL THEN 0 ELSE round(sum(weight), 9) END AS s, min(i) AS i FROM ro GROUP BY item, a)
SELECT item, i AS selected_index, a AS selected_answer, round(s, 6) AS consistency FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY s DESC, coalesce(a, 'None'), i) AS r FROM g) WHERE r = 1"""
)
def pp_select(spark, sf):
    i = F.substring("form_id", 2, 20).cast("long")
    rows = _weights(spark, sf).select("item", i.alias("rollout_index"), F.when(i % 11 != 0, (i % 5).cast("string")).alias("parsed_answer"), "weight")
    return r6(interventions.select_rollout(rows))


@query(
    f"""WITH {_SIM}, ro AS (SELECT item, vec_id AS i, CASE WHEN vec_id % 11 <> 0 THEN (vec_id % 5)::VARCHAR END AS a, round(weight, 9) AS weight FROM sm)
SELECT item, i AS rollout_index, a AS parsed_answer FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY weight DESC, coalesce(a, 'None'), i) AS r FROM ro) WHERE r = 1"""
)
def win_rank_select(spark, sf):
    i = F.substring("form_id", 2, 20).cast("long")
    rows = _weights(spark, sf).select("item", i.alias("rollout_index"), F.when(i % 11 != 0, (i % 5).cast("string")).alias("parsed_answer"), F.round("weight", 9).alias("w"))
    best = interventions.first_by(rows, ["item"], F.desc("w"), F.coalesce("parsed_answer", F.lit("None")), "rollout_index")
    return best.select("item", "rollout_index", "parsed_answer")


_SC = """
sv AS (SELECT dataset, item_id, parsed_answer, count(*) AS c, count(*) FILTER (WHERE correctness) AS y, count(correctness) AS d FROM scored_open WHERE method = 'sc_8' GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY dataset, item_id ORDER BY (parsed_answer IS NULL)::INT, c DESC, parsed_answer) AS r FROM sv),
sc AS (SELECT dataset, item_id, parsed_answer AS sc_majority, CASE WHEN d > 0 THEN y * 2 >= d END AS sc_correctness FROM sr WHERE r = 1)"""


@query(O.with_(O.SCORED, _SC) + "SELECT * FROM sc")
def pp_sc_majority(spark, sf):
    rows = fixtures.scored(spark, sf, undecided=True).filter("method = 'sc_8'")
    return interventions.plain_majority(rows, ["dataset", "item_id"])


@query("SELECT vec_id, array_to_string(list_concat(list_transform(range(8 - least(8, vec_id % 10)), lambda i: 0), range(1, vec_id % 10 + 1)), ',') AS padded FROM embeddings")
def pp_pad(spark, sf):
    rows = fixtures.table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 > 0, F.sequence(F.lit(1), (F.col("vec_id") % 10).cast("int"))).otherwise(F.array().cast("array<int>")).alias("ids"))
    return rows.select("vec_id", F.array_join(interventions.left_pad("ids", 8, 0).cast("array<string>"), ",").alias("padded"))


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    """One row per item: an intervention's outcome from the eight-form method against
    the one-form samples."""
    rows = fixtures.scored(spark, sf, undecided=True)
    chosen = metrics.majority(rows.filter("method = 'scop_8x1'"), ["dataset", "item_id"]).select("dataset", "item_id", F.col("majority_correct").alias("correctness"))
    first = rows.filter("method = 'scop_8x1' and form_id = 'original'").select("dataset", "item_id", F.col("correctness").alias("initial_correctness"))
    sc = interventions.plain_majority(rows.filter("method = 'sc_8'"), ["dataset", "item_id"]).drop("sc_majority")
    spread = rows.filter("method = 'sc_8'").groupBy("dataset", "item_id").agg((F.count_distinct("parsed_answer") > 1).alias("sc_disagrees"), F.sum("output_tokens").alias("sc_output_tokens"))
    cost = rows.filter("method = 'scop_8x1'").groupBy("dataset", "item_id").agg(F.sum("output_tokens").alias("ppcv_output_tokens"), F.min("gpu_seconds").alias("probe_seconds"), F.sum("gpu_seconds").alias("ppcv_seconds"))
    on = ["dataset", "item_id"]
    return chosen.join(first, on).join(sc, on).join(spread, on).join(cost, on)


_TRIALS = (
    O.vote("ppx", "dataset, item_id", "pv")
    + """,
tx AS (SELECT p.dataset, p.item_id, p.majority_correct AS y, i.correctness AS z, s.sc_correctness AS s, u.dis, u.st, k.pt, k.pr, k.ps FROM pv p
    JOIN (SELECT * FROM scored_open WHERE method = 'scop_8x1' AND form_id = 'original') i USING (dataset, item_id) JOIN sc s USING (dataset, item_id)
    JOIN (SELECT dataset, item_id, count(DISTINCT parsed_answer) > 1 AS dis, sum(output_tokens) AS st FROM scored_open WHERE method = 'sc_8' GROUP BY ALL) u USING (dataset, item_id)
    JOIN (SELECT dataset, item_id, sum(output_tokens) AS pt, min(gpu_seconds) AS pr, sum(gpu_seconds) AS ps FROM ppx GROUP BY ALL) k USING (dataset, item_id))"""
)
_TRIAL_CTES = O.with_(O.SCORED, _SC, "ppx AS (SELECT * FROM scored_open WHERE method = 'scop_8x1')", _TRIALS)


@query(
    _TRIAL_CTES
    + """SELECT count(*) AS n, round(avg(y::INT), 6) AS ppcv_accuracy, round(avg(s::INT), 6) AS sc_accuracy, count(*) FILTER (WHERE z = false) AS baseline_error_n, round(avg(y::INT) FILTER (WHERE z = false), 6) AS baseline_error_accuracy,
count(*) FILTER (WHERE dis) AS disagreement_n, round(avg(y::INT) FILTER (WHERE dis), 6) AS disagreement_ppcv_accuracy, round(avg(s::INT) FILTER (WHERE dis), 6) AS disagreement_sc_accuracy,
round(avg(pt), 6) AS mean_ppcv_output_tokens, round(avg(st), 6) AS mean_sc_output_tokens, round(avg(pr), 6) AS mean_probe_seconds, round(avg(ps), 6) AS mean_ppcv_seconds, round(quantile_cont(ps, 0.95), 6) AS p95_ppcv_seconds,
round(avg(y::INT) - avg(s::INT), 6) AS ppcv_minus_sc FROM tx"""
)
def agg_ppcv_fidelity(spark, sf):
    return r6(interventions.summarize(_trials(spark, sf)))


@query(_TRIAL_CTES + ", lite AS (SELECT s.* FROM scored s SEMI JOIN (SELECT item_id FROM tx WHERE z = false) USING (item_id) WHERE method <> 'main'),\n" + O.items("lite").strip() + ",\n" + O.calibration().strip() + " " + O.BUDGET_SELECT)
def agg_ppcv_lite(spark, sf):
    chosen = _trials(spark, sf).filter("not initial_correctness").select("item_id")
    return r6(metrics.fixed_budget(fixed_rows(spark, sf).join(chosen, "item_id", "left_semi")))


@query(_TRIAL_CTES + "SELECT dataset, item_id, z IS NOT NULL AND NOT z AS baseline_error, dis AS sc_disagrees FROM tx")
def flt_conditional(spark, sf):
    return _trials(spark, sf).select("dataset", "item_id", F.coalesce(~F.col("initial_correctness"), F.lit(False)).alias("baseline_error"), "sc_disagrees")


@query(O.with_(O.SCORED) + "SELECT dataset, item_id, count(*) AS n_rollouts, (sum(output_tokens) FILTER (WHERE form_id = 'original'))::BIGINT AS initial_tokens, sum(output_tokens)::BIGINT AS total_output_tokens FROM scored WHERE method IN ('sc_8', 'scop_8x1') GROUP BY ALL")
def pp_costs(spark, sf):
    rows = fixtures.scored(spark, sf).filter("method in ('sc_8', 'scop_8x1')")
    first = F.sum(F.when(F.col("form_id") == "original", F.col("output_tokens")))
    return rows.groupBy("dataset", "item_id").agg(F.count("*").alias("n_rollouts"), first.alias("initial_tokens"), F.sum("output_tokens").alias("total_output_tokens"))


def _stub():
    """A stand-in for a model: what it answers follows from the token it begins with, or
    from the number of the sample."""
    import json

    def reply(text: str) -> str:
        asked = json.loads(text)
        n = asked["prefix"][-1] % 5 if asked["prefix"] else int(asked["prompt"].rsplit("#", 1)[1]) % 3
        return f"so the answer is {n}"

    return lambda prompts: [reply(p) for p in prompts]


#: Forms of an item are rotations of its vector at the first position; the first is the original.
@query(
    "WITH "
    + _TRAJ.strip()
    + """, sf AS (SELECT item, form_no, logits AS v FROM tr WHERE position = 0),
w AS (SELECT a.item, a.form_no, CASE WHEN a.form_no = 0 THEN 1.0 ELSE greatest(0, list_cosine_similarity(a.v, b.v)) END AS weight FROM sf a JOIN sf b ON a.item = b.item AND b.form_no = 0),
ro AS (SELECT g.item, k * 3 + w.form_no AS i, g.candidates[k + 1] AS token, w.form_no, (g.candidates[k + 1] % 5)::VARCHAR AS answer, weight
    FROM (SELECT cd.item, candidates, unnest(range(len(candidates))) AS k FROM cd JOIN cr ON cr.item = cd.item AND cr.critical_position = cd.position) g JOIN w ON w.item = g.item),
sc AS (SELECT item, answer, round(sum(weight), 9) AS s, min(i) AS i FROM ro GROUP BY item, answer),
best AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY s DESC, answer, i) AS r FROM sc),
n AS (SELECT item, count(*) AS initial_tokens FROM tr WHERE form_no = 0 GROUP BY item), m AS (SELECT item, count(*) AS n_rollouts FROM ro GROUP BY item)
SELECT b.item, critical_position, round(critical_score, 6) AS critical_score, b.i AS selected_index, b.answer AS selected_answer, round(b.s, 6) AS consistency, ro.token::INTEGER AS selected_token,
    b.answer = '2' AS correctness, n_rollouts, initial_tokens, initial_tokens + 5 * n_rollouts AS ppcv_output_tokens, '0' AS sc_majority, false AS sc_correctness, true AS sc_disagrees, 40::BIGINT AS sc_output_tokens
FROM best b JOIN ro ON ro.item = b.item AND ro.i = b.i JOIN cr ON cr.item = b.item JOIN n ON n.item = b.item JOIN m ON m.item = b.item WHERE r = 1"""
)
def pp_run_item(spark, sf):
    """The whole run over stored logits, with a stand-in for the model. Stored
    trajectories may be of one token; they have rows like the others."""
    rows = fixtures.trajectories(spark, sf)
    named = F.get(fixtures.literal_array(C.FORM_IDS), F.col("form_no"))
    surfaces = rows.filter("position = 0").select("item", "form_no", named.alias("form_id"), F.concat("item", F.lit(" "), named).alias("prompt"), F.lit("gsm_symbolic").alias("dataset"), F.lit("2").alias("canonical_answer"), F.col("logits").alias("v"))
    return r6(intervening.run_items(rows, surfaces, _stub, 11, 8, shortest=1)).drop("selected_form")


# -- reports, gates, lifecycle ---------------------------------------------------


@query(
    O.with_(O.SCORED)
    + """, g AS (SELECT mode, method, avg(truncated::INT) AS truncation_rate, avg((correctness IS NULL)::INT) AS undecided_rate, avg((NOT answer_format_ok)::INT) AS format_violation_rate,
(count(*) - count(DISTINCT (dataset, item_id, form_id, mode, method, sample_index)))::DOUBLE AS duplicate_keys, abs(1500 - count(*))::DOUBLE AS incomplete_rows FROM scored_open GROUP BY ALL)
SELECT mode, method, gate, round(value, 6) AS value, CASE gate WHEN 'truncation_rate' THEN 0.05 WHEN 'undecided_rate' THEN 0.02 WHEN 'format_violation_rate' THEN 0.10 ELSE 0 END::DOUBLE AS allowed,
value > CASE gate WHEN 'truncation_rate' THEN 0.05 WHEN 'undecided_rate' THEN 0.02 WHEN 'format_violation_rate' THEN 0.10 ELSE 0 END::DOUBLE AS failed
FROM (UNPIVOT g ON truncation_rate, undecided_rate, format_violation_rate, duplicate_keys, incomplete_rows INTO NAME gate VALUE value)"""
)
def gt_results(spark, sf):
    rows = fixtures.scored(spark, sf, undecided=True)
    progress = rows.groupBy("mode", "method").agg(F.count("*").alias("completed")).withColumn("expected", F.lit(1500).cast("long"))
    return r6(adjudicate.result_gates(rows, SAMPLE_KEY, ["mode", "method"], progress))


@query(
    O.with_(O.REWORDINGS)
    + """, e AS (SELECT dataset, item_id, form_id FROM rewordings_all WHERE split = 'pilot'), r AS (SELECT * FROM rewordings WHERE split = 'pilot'),
q AS (SELECT transformation_type, avg("""
    + f"{_WORDS('rewording_text')} / greatest(1, {_WORDS('original_text')})"
    + """) < 0.85 AS below FROM r GROUP BY ALL)
SELECT (SELECT count(*) FROM e) AS expected_pairs, (SELECT count(*) FROM r) AS accepted_pairs, (SELECT count(*) FROM r WHERE rewording_text = 'voice') AS failed_gate_count,
(SELECT count(*) FROM (FROM e EXCEPT SELECT dataset, item_id, form_id FROM r)) AS missing_count, 0::BIGINT AS unexpected_count, 0::BIGINT AS duplicate_count, (SELECT count(*) FROM q WHERE below) AS shortened_count, false AS passed""",
    C.REWORDING_GATE,
)
def rewording_gate(spark, sf):
    rows = fixtures.rewordings(spark, sf).filter("split = 'pilot'")
    expected = keysets.expected_pairs(fixtures.manifest(spark, sf), C.FORM_IDS[1:], "pilot")
    ratios = adjudicate.word_ratios(rows, records.word_ratio("rewording_text", "original_text"))
    return adjudicate.rewording_report(expected, rows, ratios, F.col("rewording_text") == "voice")


@query(
    O.with_(O.REWORDINGS)
    + f""", e AS (SELECT dataset, item_id, form_id FROM rewordings_all WHERE split = 'smoke'),
t AS (SELECT dataset, item_id, form_id, 1 + {O._seed('item_id', 'form_id')} % 4 AS attempt, {O._seed('form_id', 'item_id')} % 3 = 0 AS accepted FROM rewordings WHERE split = 'smoke')
SELECT dataset, item_id, form_id, (coalesce(attempt, 0) + 1)::BIGINT AS attempt FROM e LEFT JOIN t USING (dataset, item_id, form_id) WHERE NOT coalesce(accepted, false) AND coalesce(attempt, 0) < 4"""
)
def st_retry(spark, sf):
    expected = keysets.expected_pairs(fixtures.manifest(spark, sf), C.FORM_IDS[1:], "smoke")
    tried = fixtures.rewordings(spark, sf).filter("split = 'smoke'").select(*_KEY3, (1 + keys.stable_seed("item_id", "form_id") % 4).alias("attempt"), (keys.stable_seed("form_id", "item_id") % 3 == 0).alias("accepted"))
    return resume.retry_pending(expected, tried, _KEY3, C.MAX_ATTEMPTS)


@query(O.with_(O.SCORED) + "SELECT count(*) AS expected_records, count(*) FILTER (WHERE marker < 60) AS completed_records, count(*) = count(*) FILTER (WHERE marker < 60) AS complete, 'f' AS config_fingerprint FROM scored")
def st_progress(spark, sf):
    rows = fixtures.scored(spark, sf)
    return resume.progress_report(rows, rows.filter("marker < 60"), SAMPLE_KEY, "f")


@query("SELECT event_id, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE round(v, 6) END AS cleaned FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE value END AS v FROM events)")
def hp_clean(spark, sf):
    v = F.expr("CASE event_id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') ELSE value END")
    rows = fixtures.table(spark, sf, "events").select("event_id", v.alias("v"))
    return r6(rows.select("event_id", keys.cleaned(F.col("v"), rows.schema["v"].dataType).alias("cleaned")))


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def hp_mean(spark, sf):
    return r6(fixtures.table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("mean")))


@query(_TRIAL_CTES + "SELECT dataset, round(avg(y::INT), 6) AS accuracy, count(*) FILTER (WHERE dis) AS n_disagreements FROM tx GROUP BY ALL")
def hp_acc(spark, sf):
    rows = _trials(spark, sf)
    return r6(rows.groupBy("dataset").agg(F.avg(metrics.number("correctness")).alias("accuracy"), F.count_if("sc_disagrees").alias("n_disagreements")))


@query("SELECT event_id, user_id, event_type FROM events")
def src_jsonl(spark, sf):
    """Written as JSON lines and read under a schema that stops at bad rows."""
    rows = fixtures.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    path = files.shared_folder(spark, "jsonl")
    files.append_jsonl(rows, path)
    return files.read_jsonl(spark, path, "event_id long, user_id long, event_type string")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS number FROM events")
def src_jsonl_lines(spark, sf):
    """One file of JSON lines in order of id, read in ranges of bytes: each row's line."""
    path = files.shared_folder(spark, "lines")
    files.append_jsonl(fixtures.table(spark, sf, "events").select("event_id", "user_id").repartitionByRange(1, "event_id").sortWithinPartitions("event_id"), path)
    return files.read_numbered_jsonl(spark, path, "event_id long, user_id long").select("event_id", "number")


@query("SELECT count(*) AS written, count(*) AS again, 2 * count(*) AS stored FROM events", "snk_jsonl_once")
def snk_jsonl_once(spark, sf):
    """Two appends, one of them repeated under its token: its rows are there once."""
    rows = fixtures.table(spark, sf, "events").select("event_id")
    path = files.shared_folder(spark, "append")
    first = files.append_jsonl(rows, path, "a")
    files.append_jsonl(rows, path, "b")
    again = files.append_jsonl(rows, path, "a")
    stored = files.read_jsonl(spark, path, "event_id long").agg(F.count("*").alias("stored"))
    return stored.select(F.lit(first).cast("long").alias("written"), F.lit(again).cast("long").alias("again"), "stored")


@query("SELECT (SELECT count(*) FROM events) AS written, 2 * (SELECT count(*) FROM events) AS stored")
def snk_jsonl(spark, sf):
    rows = fixtures.table(spark, sf, "events").select("event_id")
    path = files.shared_folder(spark, "append")
    files.append_jsonl(rows, path)
    n = files.append_jsonl(rows, path)
    return files.read_jsonl(spark, path, "event_id long").agg(F.lit(n).cast("long").alias("written"), F.count("*").alias("stored"))


@query(O.with_(O.SCORED) + "SELECT dataset, item_id, form_id, mode, method, sample_index, parsed_answer, correctness FROM scored")
def snk_parquet(spark, sf):
    path = files.shared_folder(spark, "scored")
    files.write_parquet(fixtures.scored(spark, sf).select(*SAMPLE_KEY, "parsed_answer", "correctness"), path)
    return spark.read.parquet(path)


@query(
    O.with_(O.COMPLETIONS)
    + "SELECT dataset, NULL::VARCHAR AS item_id, NULL::VARCHAR AS form_id, NULL::VARCHAR AS mode, NULL::VARCHAR AS seed, NULL::VARCHAR AS method, raw_extracted_answer, canonical_answer, 'fallback_normalized' AS parser_status FROM judgeable WHERE judge_required"
)
def snk_csv_queue(spark, sf):
    """The queue's nine columns; what completions don't have is empty."""
    path = files.shared_folder(spark, "queue")
    files.write_queue(adjudicate.queue(answers.score(fixtures.completions(spark, sf))), path)
    return files.read_csv(spark, path)


@query(f"WITH {_AUDIT} SELECT audit_id::VARCHAR AS audit_id, e AS equivalence FROM a")
def snk_csv_audit(spark, sf):
    path = files.shared_folder(spark, "audit")
    files.write_queue(fixtures.audit(spark, sf), path, ["audit_id", "equivalence"])
    return files.read_csv(spark, path)


@query("SELECT event_id, user_id, event_type FROM events")
def st_append_resume(spark, sf):
    """Two runs over the same stream: the second adds nothing."""
    base = files.shared_folder(spark, "stream")
    schema = fixtures.table(spark, sf, "events").select("event_id", "user_id", "event_type").schema
    for run in ("a", "b"):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        resume.append_new(stream, ["event_id"], f"{base}/log", f"{base}/checkpoint-{run}")
    return resume.read_log(spark, f"{base}/log", schema)
