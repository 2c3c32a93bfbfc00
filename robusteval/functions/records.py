"""Source rows to manifest rows, candidate cleaning, prompts and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval.functions.keys import as_column

#: White space as the text functions strip it (fixed values).
EDGES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x) -> Column:
    return F.btrim(as_column(x), F.lit(EDGES))


def gsm_gold(answer) -> Column:
    """What follows the last ####, trimmed, without thousands separators."""
    return F.replace(strip(F.substring_index(strip(answer), "####", -1)), F.lit(","), F.lit(""))


def item_id(dataset, fields: list, fallback: Column) -> Column:
    """dataset:field:field of the fields that are not null, else a short digest."""
    joined = F.concat_ws(":", *[as_column(f).cast("string") for f in fields])
    return F.concat(as_column(dataset), F.lit(":"), F.when(F.coalesce(*[as_column(f).cast("string") for f in fields]).isNotNull(), joined).otherwise(F.substring(F.sha2(fallback, 256), 1, 16)))


def required(value: Column, what: str) -> Column:
    """The value; a row without one stops the query."""
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.raise_error(F.lit(f"a source row has no {what}")))


def normalize_source(rows: DataFrame, revision: str = "0" * 40) -> DataFrame:
    """(dataset, id, instance, question, answer) to manifest rows."""
    answer = required(strip("answer"), "answer")
    return rows.select(
        "dataset",
        item_id("dataset", ["id", "instance"], F.concat_ws("|", "dataset", "question")).alias("item_id"),
        F.col("id").alias("source_index"),
        F.lit(revision).alias("source_revision"),
        required(strip("question"), "question").alias("original_text"),
        answer.alias("gold_answer"),
        F.when(F.col("dataset") == "gsm_symbolic", gsm_gold("answer")).otherwise(answer).alias("canonical_answer"),
    )


def clean_candidate(text) -> Column:
    """Trimmed, without the known lead-ins and one pair of matching quotes."""
    value = strip(text)
    for prefix in C.CLEANED_PREFIXES:
        value = F.when(F.startswith(F.lower(value), F.lit(prefix.lower())), strip(F.substr(value, F.lit(len(prefix) + 1)))).otherwise(value)
    first, last = F.substring(value, 1, 1), F.substring(value, -1, 1)
    quoted = (F.length(value) >= 2) & (first == last) & first.isin('"', "'")
    return F.when(quoted, strip(F.substr(value, F.lit(2), F.length(value) - 2))).otherwise(value)


def fill(template: str, **values: Column) -> Column:
    """A template with {name} places filled by columns, in one concatenation."""
    parts, rest = [], template
    while rest:
        found = min(((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest), default=None)
        if found is None:
            parts.append(F.lit(rest))
            break
        at, name = found
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def lookup(pairs: list[tuple], key: Column) -> Column:
    """A small fixed mapping as a chain of conditions; null where nothing fits."""
    out = F.lit(None)
    for name, value in reversed(pairs):
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def generation_prompt(original, transformation) -> Column:
    kind = as_column(transformation)
    return fill(C.GENERATION_PROMPT, type=kind, instruction=lookup(C.INSTRUCTIONS, kind), original=as_column(original))


def judge_prompt(original, candidate) -> Column:
    return fill(C.JUDGE_PROMPT, original=as_column(original), candidate=as_column(candidate))


def blinded_prompt(gold, response) -> Column:
    return fill(C.BLINDED_PROMPT, gold=as_column(gold), response=as_column(response))


def messages(user, mode) -> Column:
    """Chat messages of a prompt: reasoning has no system turn."""
    text, kind = as_column(user), as_column(mode)
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    plain = F.array(one("system", F.lit(C.SYSTEM_PROMPT)), one("user", text))
    return F.when(kind == "reasoning", F.array(one("user", F.concat(text, F.lit(C.REASONING_SUFFIX))))).otherwise(plain)


def thinking_switch(mode) -> Column:
    """True or false for the two chat modes, null for reasoning."""
    kind = as_column(mode)
    return F.when(kind.isin("thinking", "non_thinking"), kind == "thinking")


def sampling(mode, protocol) -> Column:
    """struct(temperature, top_p, top_k, min_p) of a mode and protocol."""
    kind, how = as_column(mode), as_column(protocol)
    out = F.lit(None)
    for m, p, t, tp, tk, mp in C.SAMPLING:
        setting = F.struct(F.lit(t).alias("temperature"), F.lit(tp).alias("top_p"), F.lit(tk).alias("top_k"), F.lit(mp).alias("min_p"))
        out = F.when((kind == m) & (how == p), setting).otherwise(out)
    return out


def max_tokens(mode, dataset) -> Column:
    kind, of = as_column(mode), as_column(dataset)
    out = F.lit(None)
    for m, d, n in C.MAX_TOKENS:
        out = F.when((kind == m) & (of == d), F.lit(n)).otherwise(out)
    return out


def parse_reply(reply, fields: list[str]) -> Column:
    """struct(parse_ok, <fields>) of the JSON object inside a judge's reply. A
    reply is good only if every field is a boolean; else it is uncertain."""
    body = F.regexp_extract(as_column(reply), r"(?s)\{.*\}", 0)
    value = F.try_parse_json(F.when(body != "", body))
    flags = [F.try_variant_get(value, f"$.{f}", "boolean") for f in fields]
    kinds = [F.schema_of_variant(F.try_variant_get(value, f"$.{f}", "variant")) == "BOOLEAN" for f in fields]
    ok = F.lit(True)
    for k in kinds:
        ok = ok & F.coalesce(k, F.lit(False))
    named = [F.when(ok, x).otherwise(F.lit(True) if f == "uncertain" else F.lit(None)).alias(f) for f, x in zip(fields, flags)]
    return F.struct(ok.alias("parse_ok"), *named)


def accepted(parsed: Column) -> Column:
    """Whether a rewording's judgment accepts it."""
    yes = [parsed["parse_ok"], parsed["equivalent"], ~parsed["uncertain"], parsed["target_preserved"], parsed["no_added_hint"]]
    out = F.lit(True)
    for y in yes:
        out = out & F.coalesce(y, F.lit(False))
    return out


def words(text) -> Column:
    return F.filter(F.split(as_column(text), r"(?U)\s+"), lambda w: w != "")


def word_ratio(rewording, original) -> Column:
    return F.size(words(rewording)) / F.greatest(F.lit(1), F.size(words(original)))
