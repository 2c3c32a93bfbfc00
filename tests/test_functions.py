import random
import re
from collections import Counter
from decimal import Decimal
from difflib import SequenceMatcher
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval.functions import answers, gates, keys, records
from robusteval.operators import adjudicate
from robusteval.session import dealt
from robusteval.sources import fixtures


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_stable_seed_matches_the_driver(spark):
    parts = ["a", "b:c", "é", "1103"]
    got = values(spark, lambda v: keys.stable_seed(F.lit(C.RUN_SEED), v, F.lit(3)), parts)
    assert got == [keys.stable_seed_value(C.RUN_SEED, p, 3) for p in parts]


@pytest.mark.parametrize("text,want", [("work\n#### 1,250", "1250"), (" 7 ", "7"), ("a #### 3 #### 4,000 ", "4000"), ("", "")])
def test_gold(spark, text, want):
    assert values(spark, records.gsm_gold, [text]) == [want]


def test_item_id(spark):
    df = spark.createDataFrame([("gsm_symbolic", 4, 2), ("math_500", None, 7), ("x", None, None)], "d string, id int, instance int")
    got = [r.x for r in df.select(records.item_id("d", ["id", "instance"], F.lit("row")).alias("x")).collect()]
    assert got[:2] == ["gsm_symbolic:4:2", "math_500:7"]
    assert re.fullmatch("x:[0-9a-f]{16}", got[2])


EXTRACTS = [
    (r"so \boxed{1/2}", "m", ("1/2", "boxed")),
    (r"\boxed{\frac{1}{2}}", "m", (r"\frac{1}{2}", "boxed")),
    (r"\boxed{1} and \boxed{2", "m", (None, "unparsed")),
    (r"\boxed{1} and \boxed{2 final answer: 9. ", "m", ("9", "answer_phrase")),
    ("The answer is 4\nanswer = 5. .", "m", ("5", "answer_phrase")),
    ("we get 3 then 1,250", "gsm_symbolic", ("1,250", "last_number_fallback")),
    ("we get 3 then 1,250", "math_500", (None, "unparsed")),
    ("", "gsm_symbolic", (None, "unparsed")),
    (None, "gsm_symbolic", (None, "unparsed")),
    (r"\BOXED {a}b}", "m", ("a", "boxed")),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, t, d) for i, (t, d, _) in enumerate(EXTRACTS)], "i int, raw_output string, dataset string")
    got = [(r.raw_extracted_answer, r.extraction_method) for r in answers.extract(df).orderBy("i").collect()]
    assert got == [w for _, _, w in EXTRACTS]


NORMAL = {
    "50%": "0.5", "2/4": "1/2", "1,250": "1250", "4/2": "2/1", "-0": "-0", "00012.500": "12.5", "1000000%": "10000", "1/0": "1/0",
    r"\$5": r"\$5", "$5$": "5", r"\text{7}": "7", r"\left(3\right)": "(3)", " a b ": "ab", "5.": "5", ".5": "0.5", "+3": "3", "-6/4": "-3/2",
    "0.0": "0", "7%": "0.07", "0%": "0", "-150%": "-1.5", "x%": "x%", "": "", "12. ": "12", r"1\,000": "1000", "0/5": "0/1", "100": "100",
}
EXOTIC = {"1e5": "100000", "1_000": "1000", "inf": "Infinity", "nan": "NaN", "0.00000001%": "1E-10", "٣": "3", "12.50%": "0.125", "1E-3": "0.001"}


def test_normal_forms(spark):
    assert dict(zip(NORMAL, values(spark, answers.normalize_answer, list(NORMAL)))) == NORMAL
    assert values(spark, answers.normalize_answer, [None]) == [None]


def by_decimals(text):
    """What decimal arithmetic makes of a cleaned answer."""
    try:
        if text.endswith("%"):
            return str(Decimal(text[:-1]) / 100)
        if re.fullmatch(r"[-+]?\d+/\d+", text):
            f = Fraction(text)
            return f"{f.numerator}/{f.denominator}"
        shown = f"{Decimal(text).normalize():f}"
    except (ArithmeticError, ValueError):
        return text
    return shown.rstrip("0").rstrip(".") if "." in shown else shown


def test_unusual_numerals_are_exact(spark):
    both = NORMAL | EXOTIC
    assert dict(zip(both, values(spark, answers.normalize_answer, list(both)))) == both
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(rng.randint(0, n)))
    texts = ["12.5%", "0.5%", "100.0%", "100%", "0.0%", "-0.00%", "0.00000000%", "1e5%", "125e3%", "9" * 29, "9" * 28 + "5", "8" * 27 + "50", "1" * 28 + "5", "-Inf", "+infinity%", "nan007", "sNaN", "e5", ".e5", "5e", "1__0", "_", "1/2/3", "3/0", "١٢/٦", "٥٠%", "1e-9", "0e7", "-0e-3", "1/" + "7" * 30, "x5", "5x", "--5", "1e0005", "%"]
    for _ in range(600):
        text = rng.choice(["", "-", "+"]) + digits(rng.choice([3, 12, 32])) + rng.choice(["", "", ".", "." + digits(rng.choice([3, 12, 32]))])
        text += rng.choice(["", "", f"e{rng.randint(-12, 12)}", f"E+{rng.randint(0, 5)}"]) + rng.choice(["", "", "%"])
        texts.append(text.rstrip(". "))
    for _ in range(100):
        texts.append(f"{rng.choice(['', '-', '+'])}{digits(25)}/{digits(25)}")
    assert dict(zip(texts, values(spark, answers.normalize_answer, texts))) == {t: by_decimals(t) for t in texts}


def test_plain_numerals_agree_with_decimals(spark):
    rng = random.Random(2)
    texts = [f"{rng.choice(['', '-', '+'])}{rng.randrange(10 ** rng.randint(1, 12))}{rng.choice(['', '.' + str(rng.randrange(10 ** rng.randint(1, 8)))])}" for _ in range(300)]
    want = []
    for t in texts:
        x = format(Decimal(t).normalize(), "f")
        want.append((x.rstrip("0").rstrip(".") if "." in x else x) or "0")
    assert values(spark, answers.normalize_answer, texts) == want
    pairs = [(rng.randrange(1, 10**6), rng.randrange(1, 10**6)) for _ in range(200)]
    got = values(spark, answers.normalize_answer, [f"{a}/{b}" for a, b in pairs])
    assert got == [f"{Fraction(a, b).numerator}/{Fraction(a, b).denominator}" for a, b in pairs]
    whole = [str(rng.randrange(10**9)) + "%" for _ in range(100)]
    assert values(spark, answers.normalize_answer, whole) == [str(Decimal(t[:-1]) / 100) for t in whole]


def test_scores(spark):
    rows = [("m", "1/2", r"\boxed{1/2}"), ("m", "5", "answer: 5."), ("m", "5", "nothing"), ("gsm_symbolic", "0.5", r"\boxed{50\%}"), ("m", "2", r"\boxed{2.0}")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, dataset string, canonical_answer string, raw_output string")
    got = answers.score(df).orderBy("i").collect()
    assert [(r.raw_exact_match, r.normalized_match, r.canonical_match, r.judge_required, r.answer_format_ok) for r in got] == [
        (True, True, True, False, True), (True, True, True, False, False), (False, False, None, True, False), (False, False, False, False, True), (False, True, True, True, True),
    ]
    assert got[2].judge_status == "pending" and got[2].correctness is None
    fixed = lambda gold, text, raw: F.struct(F.lit(False).alias("match"), F.lit("own").alias("status"))
    other = answers.score(df, equivalence=fixed).first()
    assert other.parser_status == "own" and other.judge_required


def test_decimal_percents_are_equal_to_their_decimals(spark):
    rows = [("m", "0.125", r"\boxed{12.5\%}"), ("m", "0.125", r"\boxed{12.5%}"), ("m", "100000", r"\boxed{1e5}"), ("m", "1000", "the answer is 1_000.")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, dataset string, canonical_answer string, raw_output string")
    got = answers.score(df).orderBy("i").collect()
    assert [(r.canonical_match, r.judge_required) for r in got] == [(False, False), (True, True), (True, True), (True, True)]


def test_symbolic_equivalence_tries_the_output_then_the_answer(spark):
    def verify(gold, candidate):
        error = F.when(candidate.contains("?"), F.lit("ParseError"))
        return F.struct(candidate.endswith(gold).alias("match"), error.alias("error"))

    rows = [("m", "5", "we get 5"), ("m", "5", r"\boxed{5} is it"), ("m", "5", "nothing"), ("m", "5", "what? 5"), ("m", "5", r"\boxed{6} is it")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, dataset string, canonical_answer string, raw_output string")
    got = answers.score(df, equivalence=answers.symbolic(verify, "rules")).orderBy("i").collect()
    assert [(r.canonical_match, r.parser_status) for r in got] == [(True, "rules_full"), (True, "rules_extracted"), (False, "rules_full"), (None, "rules_error:ParseError"), (False, "rules_extracted")]
    assert got[3].judge_required


def test_nested_and_flat_boxes(spark):
    texts = [r"a}b", "a{b}c}d", "{}}", "a{b", "", "}", " x }", "a{b}}c{d}", "\n q\t}"]
    want = ["a", "a{b}c", "{}", None, None, "", "x", "a{b}", "q"]
    assert values(spark, answers.braced, texts) == want
    many = "".join(f"{{{k}}}" for k in range(30))
    deep = "{" * 12 + "x" + "}" * 12
    assert values(spark, answers.braced, [many + "}z", deep + "}z", many, "a{b}{c{d}}e}"]) == [many, deep, None, "a{b}{c{d}}e"]


def test_scoring_is_worked_out_once_after_the_rows_are_dealt(spark, sf_dir):
    """A filter on scores isn't moved below them, nor before the rows are dealt out."""
    waiting = adjudicate.queue(answers.score(fixtures.completions(spark, sf_dir)))
    plan = waiting._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("boxed\\s") == 1
    assert plan.index("Filter") < plan.index("Generate") < plan.index("Repartition")


def test_rows_are_dealt_by_their_number(spark, tmp_path):
    spark.range(1000).coalesce(1).write.option("parquet.block.size", 1).parquet(str(tmp_path / "t"))
    assert dealt(spark.read.parquet(str(tmp_path / "t")), 100).rdd.getNumPartitions() == 10
    assert dealt(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_edit_distance_reads_one_pair_at_a_time(spark, sf_dir):
    """Batches are of few rows, and texts aren't copied out of Arrow all at once."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        pairs = fixtures.gate_pairs(spark, sf_dir)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
        plan = pairs.select(gates.edit_distance("original", "rewording").alias("d"))._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "], 250" in plan
        both = spark.createDataFrame([("a b c", "a  B c"), ("abc", None), (None, "x"), ("abcd", "abxd"), ("", "")], "a string, b string")
        assert [r.d for r in both.select(gates.edit_distance("a", "b").alias("d")).collect()] == [0.0, None, None, 0.25, 0.0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def numbers_of(text):
    found = re.findall(r"(?<![\w.])[-+]?\d[\d,]*(?:\.\d+)?(?:/\d+)?%?", text)
    return Counter(x.replace(",", "").removeprefix("+") for x in found)


def test_gate_texts_against_the_standard_library(spark):
    rng = random.Random(4)
    bits = ["5", "1,200", "3.5", "+7", "-2", "1/2", "50%", "a5", "é3", "x.4", ".5", "٣", "miles", "Feet", "kg", "<=", "==", "=", "×", "text", "foot-pound", "\n"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    assert [Counter(x) for x in values(spark, gates.numbers, texts)] == [numbers_of(t) for t in texts]
    assert [Counter(x) for x in values(spark, gates.symbols, texts)] == [Counter(re.findall(C.MATH_SYMBOL, t)) for t in texts]
    units = set(C.UNITS)
    assert [Counter(x) for x in values(spark, gates.units, texts)] == [Counter(w.lower() for w in re.findall(C.WORD, t) if w.lower() in units) for t in texts]


def test_rewording_gates(spark):
    df = spark.createDataFrame([("Ana has 3 boxes of 12 pencils. How many pencils?", "There are 3 boxes with 12 pencils each for Ana. Count the pencils?"), ("Drive 5 miles.", "Drive 6 miles.")], "o string, p string")
    rows = df.select(gates.passes_cheap("o", "p").alias("ok"), gates.edit_distance("o", "p").alias("d"), "o", "p").collect()
    assert [r.ok for r in rows] == [True, False]
    for r in rows:
        want = 1 - SequenceMatcher(None, " ".join(r.o.lower().split()), " ".join(r.p.lower().split())).ratio()
        assert r.d == pytest.approx(want)
    long = "word " * 100
    assert gates.edit_ratio_distance(long, "x" + long) == pytest.approx(1 - SequenceMatcher(None, " ".join(long.split()), "x" + " ".join(long.split())).ratio())


def test_clean_candidate(spark):
    got = values(spark, records.clean_candidate, [f'{C.CLEANED_PREFIXES[0]} "hi"', "x", '"', "'a' ", f"{C.CLEANED_PREFIXES[0].upper()}  {C.CLEANED_PREFIXES[2]} q", None])
    assert got == ["hi", "x", '"', "a", "q", None]


def test_prompts_fill_their_places(spark):
    got = values(spark, lambda v: records.generation_prompt(v, F.lit("voice_or_perspective_shift")), ["P {type}"])[0]
    assert "Transformation: voice_or_perspective_shift\n" in got and got.endswith("P {type}\n")
    judge = values(spark, lambda v: records.judge_prompt(v, F.lit("{original}")), ["O"])[0]
    assert '{"equivalent": true' in judge and "CANDIDATE:\n{original}\n" in judge


def test_replies(spark):
    texts = ['x {"equivalent": true, "uncertain": false} y', '{"equivalent": 1, "uncertain": false}', "none", '{"equivalent": true}', '{"a": {"equivalent": true}}', None]
    got = values(spark, lambda v: records.parse_reply(v, ["equivalent", "uncertain"]), texts)
    assert [(r.parse_ok, r.equivalent, r.uncertain) for r in got] == [(True, True, False)] + [(False, None, True)] * 5


def test_canonical_json():
    assert keys.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert len(keys.object_fingerprint([1])) == 64


def test_canonical_json_of_any_value_is_that_of_the_library(spark):
    import json
    import random
    import struct

    rng = random.Random(6)
    doubles = [0.0, -0.0, 1.0, 1e10, 1e15, 1e16, 123456789012345680.0, 1e22, 1e-4, 0.0001234, 1e-5, 5e-324, 1.7976931348623157e308, -2.5, 100.0, 1 / 3, 9007199254740993.0, 2.0**-44]
    doubles += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(400)) if x == x and abs(x) != float("inf")]
    texts = ["", 'a"b\\c/', "é中\U0001f600", "".join(map(chr, range(40))), "\x7f "]
    rows = [(k, d, texts[k % 5], [d, None, float("nan")], {texts[k % 5] + "k": float("inf"), "a": d}, ("x" if k % 2 else None, [k, None], k % 3 == 0)) for k, d in enumerate(doubles)]
    kinds = "id long, d double, Text string, list array<double>, map map<string,double>, s struct<z string, a array<long>, b boolean>"
    df = spark.createDataFrame(rows, kinds)
    got = df.select("id", keys.canonical_row_json(df, df.columns).alias("j"), *[keys.cleaned(df[c], df.schema[c].dataType).alias(c) for c in ("list", "map")]).collect()
    clean = lambda v: None if isinstance(v, float) and (v != v or abs(v) == float("inf")) else v
    for r in got:
        i, d, t, listed, mapped, (z, a, b) = rows[r.id]
        listed, mapped = [clean(v) for v in listed], {k: clean(v) for k, v in mapped.items()}
        value = {"id": i, "d": d, "Text": t, "list": listed, "map": mapped, "s": {"z": z, "a": a, "b": b}}
        assert r.j == keys.canonical_json(value) == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.list == listed and r.map == mapped
