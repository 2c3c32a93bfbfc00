"""DuckDB SQL with the rows of registered queries, written apart from them."""

from __future__ import annotations

from robusteval import constants as C


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _seed(*parts: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 8))::BIGINT & 2147483647)"


SCORED = f"""
ev AS (SELECT user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, place % 47 AS rn, place // 47 AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events)),
blocks(method, mode, base, nf, ns) AS (VALUES ('main', 'thinking', 0, 5, 3), ('main', 'non_thinking', 0, 5, 3),
    ('sc_8', 'non_thinking', 15, 1, 8), ('scop_2x4', 'non_thinking', 23, 2, 4), ('scop_4x2', 'non_thinking', 31, 4, 2), ('scop_8x1', 'non_thinking', 39, 8, 1)),
placed AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'gsm_symbolic' ELSE 'math_500' END AS dataset, 'u' || user_id || CASE WHEN part > 0 THEN '-' || part ELSE '' END AS item_id, mode, method,
    ({_list(C.FORM_IDS)})[1 + (rn - base) // ns] AS form_id, CAST((rn - base) % ns AS INTEGER) AS sample_index, value, k,
    CASE WHEN mode = 'thinking' THEN 60.0::DOUBLE ELSE 45.0::DOUBLE END AS width
    FROM ev JOIN blocks ON rn >= base AND rn < base + nf * ns),
scored_all AS (SELECT dataset, item_id, form_id, mode, method, sample_index,
    CASE WHEN method = 'main' THEN (({_list(C.SAMPLING_SEEDS)})[sample_index + 1])::BIGINT ELSE {_seed(f"'{C.RUN_SEED}'", "method", "item_id", "form_id", "sample_index::VARCHAR")} END AS seed,
    CASE WHEN value < 250 THEN CAST(CAST(floor(value / width) AS BIGINT) AS VARCHAR) END AS parsed_answer,
    value < width AS correctness, -value / 100::DOUBLE AS normalized_log_probability,
    20 + k % 7 AS input_tokens, 40 + k AS output_tokens, (40 + k) / 100::DOUBLE AS gpu_seconds, (40 + k) / 100::DOUBLE AS latency_seconds,
    k >= 97 AS truncated, CASE WHEN k >= 97 THEN 'length' ELSE 'stop' END AS finish_reason, k >= 5 AS answer_format_ok,
    (value < width AND k % 10 <> 0) AS raw_exact_match, value < width AS normalized_match,
    CASE WHEN k <> 50 THEN value < width END AS canonical_match,
    (k = 50 OR (value < width AND k % 10 <> 0) <> (value < width)) AS judge_required, k AS marker FROM placed),
scored AS (SELECT * FROM scored_all),
scored_open AS (SELECT * REPLACE (CASE WHEN marker <> 50 THEN correctness END AS correctness) FROM scored_all)"""

MANIFEST = r"""
src AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'gsm_symbolic' ELSE 'math_500' END AS dataset, p_partkey AS id,
    CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 5 END AS instance, p_name AS question,
    CASE WHEN p_partkey % 2 = 0 THEN 'work' || chr(10) || '#### ' || (p_partkey % 9 + 1) || ',' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') ELSE ' ' || p_partkey || ' ' END AS answer FROM part),
manifest AS (SELECT dataset, dataset || ':' || concat_ws(':', id::VARCHAR, instance::VARCHAR) AS item_id, id AS source_index, repeat('0', 40) AS source_revision,
    trim(question) AS original_text, trim(answer) AS gold_answer,
    CASE WHEN dataset = 'gsm_symbolic' THEN replace(trim(regexp_extract(answer, '####\s*(.*)$', 1)), ',', '') ELSE trim(answer) END AS canonical_answer,
    CASE WHEN id % 10 = 0 THEN 'smoke' WHEN id % 10 <= 2 THEN 'pilot' ELSE 'confirmatory' END AS split FROM src)"""

FORMS_SQL = ", ".join(f"('{f}', '{t}', {i})" for i, (f, t) in enumerate(C.FORMS))
REWORDINGS = (
    MANIFEST
    + f""",
forms(form_id, transformation_type, form_no) AS (VALUES {FORMS_SQL}),
rewordings_all AS (SELECT dataset, item_id, split, source_index, original_text, canonical_answer, form_id, transformation_type,
    CASE WHEN form_id = 'voice' THEN form_id ELSE form_id || ' ' || original_text END AS rewording_text FROM manifest CROSS JOIN forms WHERE form_no > 0),
rewordings AS (SELECT * FROM rewordings_all WHERE {_seed('item_id', 'form_id')} % 11 <> 0),
found AS (SELECT dataset, item_id, 'original' AS form_id, 'original' AS transformation_type, original_text AS prompt_text, canonical_answer FROM manifest WHERE split = 'pilot'
    UNION ALL SELECT dataset, item_id, form_id, transformation_type, rewording_text, canonical_answer FROM rewordings_all WHERE split = 'pilot'),
found_gaps AS (SELECT dataset, item_id, 'original' AS form_id, 'original' AS transformation_type, original_text AS prompt_text, canonical_answer FROM manifest WHERE split = 'pilot'
    UNION ALL SELECT dataset, item_id, form_id, transformation_type, rewording_text, canonical_answer FROM rewordings WHERE split = 'pilot')"""
)

COMPLETIONS = r"""
completions AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'gsm_symbolic' ELSE 'math_500' END AS dataset, l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id,
    CAST(l_quantity AS INTEGER)::VARCHAR AS canonical_answer,
    CASE l_linenumber
    WHEN 1 THEN 'The total is \boxed{ ' || CAST(l_quantity AS INTEGER) || (['', 'e0', '.5e1', '_0', 'E+2'])[1 + l_suppkey % 5] || ' } as shown'
    WHEN 2 THEN 'First \boxed{1} then \Boxed {\frac{' || CAST(l_quantity AS INTEGER) || '}{2}} end'
    WHEN 3 THEN 'step' || chr(10) || 'So the Final answer is ' || CASE WHEN l_suppkey % 3 = 0 THEN '$' || CAST(l_quantity AS INTEGER) || ',000.50$' ELSE CAST(l_quantity AS INTEGER)::VARCHAR END || '. ' || chr(10) || 'bye'
    WHEN 4 THEN 'We use 12 and get ' || CAST(l_quantity AS INTEGER) || '/' || l_linenumber
    WHEN 5 THEN 'bad \boxed{' || CAST(l_quantity AS INTEGER) || chr(10) || 'the answer: ' || CAST(l_quantity AS INTEGER)
    WHEN 6 THEN '\boxed{\text{' || CAST(l_quantity AS INTEGER) || (['', '.5', '.0'])[1 + l_suppkey % 3] || '}%}'
    ELSE 'no number here' END AS raw_output FROM lineitem),
tails AS (SELECT *, CASE WHEN regexp_matches(raw_output, '(?i)\\boxed\s*\{') THEN regexp_extract(raw_output, '(?is)^.*\\boxed\s*\{(.*)$', 1) END AS tail FROM completions),
closed AS (SELECT *, list_min(list_filter(range(1, length(tail) + 1), lambda i: tail[i:i] = '}' AND 1 + (i - length(replace(tail[1:i], '{', ''))) - (i - length(replace(tail[1:i], '}', ''))) = 0)) AS stop FROM tails),
parts AS (SELECT * EXCLUDE (tail, stop),
    CASE WHEN stop IS NOT NULL THEN regexp_replace(tail[1:stop - 1], '^\s+|\s+$', '', 'g') END AS boxed,
    regexp_replace(regexp_replace(regexp_extract_all(raw_output, '(?i)(?:final\s+)?answer\s*(?:is|:|=)\s*([^\n]+)', 1)[-1], '^\s+|\s+$', '', 'g'), '[. ]+$', '') AS phrase,
    CASE WHEN dataset = 'gsm_symbolic' THEN regexp_extract_all(raw_output, '[-+]?\d[\d,]*(?:\.\d+)?(?:/\d+)?%?')[-1] END AS num FROM closed),
extracted AS (SELECT dataset, order_id, line_no, part_id, canonical_answer, raw_output, coalesce(boxed, phrase, num) AS raw_extracted_answer,
    CASE WHEN boxed IS NOT NULL THEN 'boxed' WHEN phrase IS NOT NULL THEN 'answer_phrase' WHEN num IS NOT NULL THEN 'last_number_fallback' ELSE 'unparsed' END AS extraction_method FROM parts),
cleaned AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(raw_extracted_answer, '^\$|\$$', '', 'g'), '\,', ''), ',', ''), '\left', ''), '\right', ''),
    '\\(?:text|mathrm)\{([^{}]*)\}', '\1', 'g'), '\s+', '', 'g'), '[. ]+$', '') AS v FROM extracted),
scored_text AS (SELECT * EXCLUDE (v), CASE
    WHEN regexp_full_match(v, '\d+(?:\.\d+)?%') THEN rtrim(rtrim(CAST(CAST(v[1:-2] AS DECIMAL(18, 2)) / 100 AS DECIMAL(18, 4))::VARCHAR, '0'), '.')
    WHEN regexp_full_match(v, '\d+(?:\.\d+)?[eE]\+?\d+') THEN (CAST(regexp_extract(v, '^[0-9.]+') AS DECIMAL(18, 2)) * CAST(10 ** CAST(regexp_extract(v, '\d+$') AS INTEGER) AS DECIMAL(18, 0)))::BIGINT::VARCHAR
    WHEN regexp_full_match(v, '\d+_\d+') THEN replace(v, '_', '')::BIGINT::VARCHAR
    WHEN regexp_full_match(v, '\d+/\d+') THEN (split_part(v, '/', 1)::BIGINT // gcd(split_part(v, '/', 1)::BIGINT, split_part(v, '/', 2)::BIGINT)) || '/' || (split_part(v, '/', 2)::BIGINT // gcd(split_part(v, '/', 1)::BIGINT, split_part(v, '/', 2)::BIGINT))
    WHEN regexp_full_match(v, '\d+') THEN v::BIGINT::VARCHAR
    WHEN regexp_full_match(v, '\d+\.\d+') THEN rtrim(rtrim(v::DECIMAL(18, 6)::VARCHAR, '0'), '.')
    ELSE v END AS parsed_answer FROM cleaned),
fully AS (SELECT *, coalesce(raw_extracted_answer = canonical_answer, false) AS raw_exact_match, coalesce(parsed_answer = canonical_answer, false) AS normalized_match,
    parsed_answer = canonical_answer AS canonical_match FROM scored_text),
judgeable AS (SELECT *, canonical_match AS correctness, extraction_method = 'boxed' AS answer_format_ok, (canonical_match IS NULL OR raw_exact_match <> normalized_match OR normalized_match <> canonical_match) AS judge_required FROM fully)"""

REPLIES = r"""
replies AS (SELECT o_orderkey AS order_id, 0 AS position, CASE o_orderkey % 4
    WHEN 0 THEN 'Sure: {"equivalent": ' || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END || ', "uncertain": false, "target_preserved": true, "no_added_hint": ' || CASE WHEN o_orderkey % 8 = 0 THEN 'true' ELSE 'false' END || ', "reason": "r"} done'
    WHEN 1 THEN '{"equivalent": true,' || chr(10) || ' "uncertain": true, "target_preserved": true, "no_added_hint": true}'
    WHEN 2 THEN 'I cannot say {not json}' ELSE '{"equivalent": "yes", "uncertain": false}' END AS reply FROM orders),
more AS (SELECT order_id, 1 AS position, '{"equivalent": true, "uncertain": false, "target_preserved": true, "no_added_hint": true}' AS reply FROM replies WHERE order_id % 5 = 0),
bodies AS (SELECT order_id, position, reply, nullif(regexp_extract(reply, '(?s)\{.*\}'), '') AS body FROM (FROM replies UNION ALL BY NAME FROM more)),
read AS (SELECT order_id, position, reply, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM bodies),
typed AS (SELECT order_id, position, reply, j, coalesce(json_type(j, '$.equivalent') = 'BOOLEAN' AND json_type(j, '$.uncertain') = 'BOOLEAN', false) AS ok2,
    coalesce(json_type(j, '$.equivalent') = 'BOOLEAN' AND json_type(j, '$.uncertain') = 'BOOLEAN' AND json_type(j, '$.target_preserved') = 'BOOLEAN' AND json_type(j, '$.no_added_hint') = 'BOOLEAN', false) AS ok4 FROM read)"""


def vote(src: str, keys: str, name: str = "maj") -> str:
    """CTEs that end in {name}(keys, n, majority_answer, confidence, majority_correct)."""
    return f"""
{name}_v AS (SELECT {keys}, parsed_answer, count(*) AS c, round(sum(coalesce(normalized_log_probability, 0)), 9) AS lp,
    count(*) FILTER (WHERE correctness) AS yes, count(correctness) AS decided FROM {src} GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY c DESC, lp DESC, parsed_answer) AS r FROM {name}_v WHERE parsed_answer IS NOT NULL),
{name}_n AS (SELECT {keys}, sum(c)::BIGINT AS n FROM {name}_v GROUP BY ALL),
{name} AS (SELECT {', '.join(f'a.{k.strip()}' for k in keys.split(','))}, n, b.parsed_answer AS majority_answer, coalesce(b.c / n, 0.0::DOUBLE) AS confidence,
    CASE WHEN b.decided > 0 THEN b.yes * 2 >= b.decided END AS majority_correct FROM {name}_n a LEFT JOIN {name}_r b
    ON {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))} AND b.r = 1)"""


GROUP = "dataset, mode, method"


def forms(src: str, by: str = GROUP, p: str = "f") -> str:
    """CTEs that end in {p}(by, item_id, form_id, solve_rate, run_variance, majority_*)."""
    keys = f"{by}, item_id, form_id"
    return (
        vote(src, keys, f"{p}m")
        + f""",
{p}s AS (SELECT {keys}, avg(correctness::INT) AS solve_rate, var_pop(correctness::INT) AS run_variance FROM {src} GROUP BY ALL),
{p} AS (SELECT * FROM {p}s JOIN {p}m USING ({keys}))"""
    )


def robust(p: str = "f", by: str = GROUP) -> str:
    return f"""
{p}t AS (SELECT {by}, count(DISTINCT form_id) AS n_forms FROM {p} GROUP BY ALL),
{p}i AS (SELECT {by}, item_id, coalesce(bool_and(majority_correct), false) AND count(majority_correct) = any_value(n_forms) AS robust,
    min(solve_rate) AS worst_form_solve_rate, count(DISTINCT majority_answer) > 1 AS answer_flip, count(DISTINCT majority_correct) > 1 AS correctness_flip,
    avg(solve_rate) AS mean_correctness, var_pop(solve_rate) AS form_variance FROM {p} JOIN {p}t USING ({by}) GROUP BY {by}, item_id)"""


def variance(p: str = "f", by: str = GROUP) -> str:
    return f"""
{p}v1 AS (SELECT {by}, avg(run_variance) AS v_run FROM {p} GROUP BY ALL),
{p}v2 AS (SELECT {by}, avg(form_variance) AS v_form, var_pop(mean_correctness) AS v_item FROM {p}i GROUP BY ALL),
{p}v AS (SELECT *, CASE WHEN v_run + v_form + v_item > 0 THEN v_form / (v_run + v_form + v_item) ELSE 0 END AS pi_form FROM {p}v1 JOIN {p}v2 USING ({by}))"""


def main_metrics(src: str, p: str = "f", by: str = GROUP) -> str:
    """CTEs that end in {p}x with all columns of the main metrics, not rounded."""
    return (
        forms(src, by, p)
        + ","
        + robust(p, by)
        + ","
        + variance(p, by)
        + f""",
{p}a AS (SELECT {by}, avg(correctness::INT) AS mean_accuracy, avg(correctness::INT) FILTER (WHERE form_id = 'original') AS original_accuracy,
    avg(correctness::INT) FILTER (WHERE form_id <> 'original') AS {C.REWORDED_ACCURACY} FROM {src} GROUP BY ALL),
{p}b AS (SELECT {by}, avg(robust::INT) AS robust_accuracy, avg(worst_form_solve_rate) AS worst_form_accuracy, avg(answer_flip::INT) AS answer_flip_rate,
    avg(correctness_flip::INT) AS correctness_flip_rate FROM {p}i GROUP BY ALL),
{p}x AS (SELECT * FROM {p}a JOIN {p}b USING ({by}) JOIN {p}v USING ({by}))"""
    )


MAIN_COLUMNS = ["mean_accuracy", "original_accuracy", C.REWORDED_ACCURACY, "robust_accuracy", "worst_form_accuracy", "answer_flip_rate", "correctness_flip_rate", "v_run", "v_form", "v_item", "pi_form"]


def rounded(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def items(src: str, by: str = GROUP) -> str:
    """CTEs that end in it(by, item_id, vote, entropy, costs) and cal(by, item_id, c, y, entropy)."""
    keys = f"{by}, item_id"
    return (
        vote(src, keys, "im")
        + f""",
ic AS (SELECT {keys}, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(gpu_seconds) AS gpu_seconds FROM {src} GROUP BY ALL),
ia AS (SELECT {keys}, parsed_answer, count(*) AS c FROM {src} WHERE parsed_answer IS NOT NULL GROUP BY ALL),
ie AS (SELECT {keys}, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy FROM ia GROUP BY ALL),
it AS (SELECT * FROM im JOIN ic USING ({keys}) LEFT JOIN ie USING ({keys})),
cal AS (SELECT {keys}, confidence AS c, majority_correct::INT::DOUBLE AS y, entropy FROM it WHERE majority_correct IS NOT NULL)"""
    )


def calibration(by: str = GROUP) -> str:
    """CTEs xb, xf, xa, xd, xe: brier, fixed and adaptive error, two areas; xz: base."""
    edges = ", ".join(f"{i} * (1.0::DOUBLE / 10)" for i in range(1, 10))
    area = lambda n, s, out: f"""
{n}0 AS (SELECT {by}, round({s}, 12) AS s, sum(1 - y) AS p, sum(y) AS q FROM cal GROUP BY {by}, round({s}, 12)),
{n}1 AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {n}0),
{n} AS (SELECT {by}, sum(p * (b + q / 2)) / nullif(sum(p) * sum(q), 0) AS {out} FROM {n}1 GROUP BY ALL)"""  # noqa: E731
    return f"""
xb AS (SELECT {by}, avg((c - y) ** 2) AS brier_score FROM cal GROUP BY ALL),
xf0 AS (SELECT {by}, len(list_filter([{edges}], lambda e: e <= c)) AS bin, count(*) AS m, abs(avg(c) - avg(y)) AS gap FROM cal GROUP BY ALL),
xf AS (SELECT {by}, sum(m * gap) / sum(m) AS ece_fixed FROM xf0 GROUP BY ALL),
xa0 AS (SELECT *, ntile(10) OVER (PARTITION BY {by} ORDER BY c, item_id) AS bin FROM cal),
xa1 AS (SELECT {by}, bin, count(*) AS m, abs(avg(c) - avg(y)) AS gap FROM xa0 GROUP BY ALL),
xa AS (SELECT {by}, sum(m * gap) / sum(m) AS ece_adaptive FROM xa1 GROUP BY ALL),
{area('xd', '1 - c', 'auroc_disagreement')},
{area('xe', 'entropy', 'auroc_entropy')},
xz AS (SELECT {by}, avg(majority_correct::INT) AS final_accuracy, avg(input_tokens) AS mean_input_tokens_per_item, avg(output_tokens) AS mean_output_tokens_per_item,
    avg(gpu_seconds) AS mean_gpu_seconds_per_item FROM it WHERE majority_correct IS NOT NULL GROUP BY ALL)"""


BUDGET_COLUMNS = ["final_accuracy", "mean_input_tokens_per_item", "mean_output_tokens_per_item", "mean_gpu_seconds_per_item", "brier_score", "ece_fixed", "ece_adaptive", "auroc_disagreement", "auroc_entropy"]
_USING = f"USING ({GROUP})"
BUDGET_SELECT = f"SELECT {GROUP}, {rounded(BUDGET_COLUMNS)} FROM xz JOIN xb {_USING} JOIN xf {_USING} JOIN xa {_USING} JOIN xd {_USING} JOIN xe {_USING}"
FIXED = "fixed AS (SELECT * FROM scored WHERE method NOT IN ('main', 'external_main'))"
MAIN = "main AS (SELECT * FROM scored WHERE method = 'main')"
MAIN_OPEN = "main AS (SELECT * FROM scored_open WHERE method = 'main')"
LAYERS = """lay AS (UNPIVOT (SELECT * EXCLUDE (correctness) RENAME (raw_exact_match AS raw, normalized_match AS normalized, canonical_match AS symbolic_pre_judge) FROM main) ON raw, normalized, symbolic_pre_judge INTO NAME layer VALUE correctness)"""

MATCHED = """
caps AS (SELECT dataset, item_id, sum(output_tokens) AS cap FROM scored WHERE method = 'sc_8' GROUP BY ALL),
lists AS (SELECT f.dataset, f.item_id, f.mode, f.method, any_value(cap) AS cap, list({'form_id': form_id, 'sample_index': sample_index, 'seed': seed, 't': output_tokens} ORDER BY form_id, sample_index, seed) AS l
    FROM fixed f JOIN caps USING (dataset, item_id) GROUP BY ALL),
folded AS (SELECT dataset, item_id, mode, method, l, list_reduce(list_prepend({'s': 0::BIGINT, 'k': []::BIGINT[], 'i': 0::BIGINT, 't': 0::BIGINT, 'cap': cap::BIGINT}, list_transform(l, lambda x: {'s': 0::BIGINT, 'k': []::BIGINT[], 'i': 0::BIGINT, 't': x.t::BIGINT, 'cap': cap::BIGINT})),
    lambda a, x: {'s': a.s + CASE WHEN len(a.k) = 0 OR a.s + x.t <= a.cap THEN x.t ELSE 0 END, 'k': CASE WHEN len(a.k) = 0 OR a.s + x.t <= a.cap THEN list_append(a.k, a.i + 1) ELSE a.k END, 'i': a.i + 1, 't': 0::BIGINT, 'cap': a.cap}).k AS kept FROM lists),
picks AS (SELECT dataset, item_id, mode, method, unnest(list_transform(kept, lambda i: l[i]), recursive := true) FROM folded)"""


def mcnemar(b: str, c: str) -> str:
    return f"CASE WHEN {b} + {c} = 0 THEN 1.0::DOUBLE ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1), lambda i: exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2))))), 9) END"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().strip(",") for c in ctes) + "\n"
