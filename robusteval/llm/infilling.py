"""Fill-in-the-middle by lookaround splitting.

A unit grammar is a list of neighbouring classes (left, right): a unit ends between
a character of the left class and one of the right. Each grammar is translated to
one zero-width regular expression, a look-behind for the left class beside a
look-ahead for the right, so splitting at it loses no character and the pieces are
the units. Two cuts, drawn from a digest of the document's id, divide the units into
prefix, middle and suffix; the output joins them in one of two orders around three
marks, and the text is rebuilt from the output alone.

All of it is one projection of built-in functions: no shuffle, and a lost task
repeats its own rows only.

Defined results: a null text is an empty one; splitting would find one empty unit
in it, so empty texts are told apart and have none (form plain); a text with a mark
in it stays plain, as its output could not be taken apart; a null id is drawn for as
an empty string; rows are independent, so ties and repeated rows don't matter (equal
ids draw alike); very long texts are split whole; a text without a boundary is one
unit; other columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robusteval.llm.common import spread_documents

#: The marks before prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY, SPACE, NOT_SPACE = r"[\s\S]", r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Unit grammars: where a unit ends, as (class of its last character, class of the next).
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "lines": [(r"\n", ANY)],
    "words": [(SPACE, NOT_SPACE)],
    "sentences": [(r"[.!?。！？]", SPACE), (r"\n", ANY)],
    "paragraphs": [(r"\n\n", r"[^\n]")],
    "runs": [(r"\p{L}", r"\P{L}"), (r"\P{L}", r"\p{L}"), (r"\p{N}", r"\P{N}"), (r"\P{N}", r"\p{N}"), (SPACE, NOT_SPACE), (NOT_SPACE, SPACE)],
    "characters": [(ANY, ANY)],
}


def boundary(grammar: str) -> str:
    """The zero-width expression of a grammar's unit ends."""
    return "|".join(f"(?<={left})(?={right})" for left, right in GRAMMARS[grammar])


def units(text: Column, grammar: str) -> Column:
    """The units of a text in order; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(doc_id: Column, seed: int, how_many: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(how_many)]


def rebuilt(output: Column, form: Column) -> Column:
    """The text of an output: what stands after the marks, put in order."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def fill_in_middle(docs: DataFrame, grammar: str = "lines", percent: int = 100, spm_percent: int = 50, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, text, output) of every row: n units;
    form plain, psm or spm; the three parts are null if plain."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drawn = [h.alias(f"h{k + 1}") for k, h in enumerate(draws(F.col("doc_id"), seed))]
    split = base.select("doc_id", "text", units(F.col("text"), grammar).alias("units"), *drawn)
    n = F.size("units")
    one, two = (F.col(h) % (n + 1) for h in ("h1", "h2"))
    marked = reduce(lambda a, b: a | b, [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    cut = split.select("doc_id", "text", "units", n.cast("long").alias("n"), form.alias("form"), F.least(one, two).cast("int").alias("a"), F.greatest(one, two).cast("int").alias("b"))

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))

    parts = cut.select(
        "doc_id", "n", "form", "text",
        part(F.lit(1), F.col("a")).alias("prefix"),
        part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"),
        part(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("suffix"),
    )
    first, second = F.concat(F.lit(PREFIX), "prefix"), F.concat(F.lit(SUFFIX), "suffix")
    joined = F.when(F.col("form") == "psm", F.concat(first, second)).otherwise(F.concat(second, first))
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.concat(joined, F.lit(MIDDLE), F.col("middle")))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", "text", output.alias("output"))


def digests(filled: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    return filled.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(rebuilt(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op11_lookaround_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(fill_in_middle(spread_documents(spark, sf_dir)))


#: The same by matching units instead of splitting between them.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS p, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(p) AS n, least(h1 % (len(p) + 1), h2 % (len(p) + 1)) AS a, greatest(h1 % (len(p) + 1), h2 % (len(p) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, array_to_string(p[1:a], '') AS pre, array_to_string(p[a + 1:b], '') AS mid, array_to_string(p[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM s"""
