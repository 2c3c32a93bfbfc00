import random

import pytest

from robusteval.functions import algebra
from robusteval.functions.algebra import equivalent, read, same

SAME = [
    (r"\frac12", "0.5"), ("(x+1)^2", "x^2+2x+1"), (r"\frac{1}{2}", "2/4"), ("1,250", "1250"), ("50%", r"\frac{1}{2}"), (r"\sqrt{8}", r"2\sqrt{2}"),
    (r"\sqrt[3]{-27}", "-3"), (r"2^{10}", "1024"), (r"\frac{x^2-1}{x-1}", "x+1"), (r"\{1,2,3\}", r"\{3, 1, 2\}"), ("1, 2", "2,1"), (r"(1,\frac12)", "(1, .5)"),
    (r"[0, \infty)", r"\left[0,\infty\right)"), (r"(-\infty,1)\cup(2,3)", r"(2,3)\cup(-\infty,1)"), ("x=5", "5"), (r"x = \pm 2", r"\{-2, 2\}"), (r"1\frac{1}{2}", "3/2"),
    (r"3\pi", r"\pi\cdot 3"), (r"5\text{ cm}", "5"), ("5 meters", "5"), (r"90^\circ", "90"), (r"\text{Tuesday}", "tuesday"), ("(1+i)^2", "2i"), (r"e^{x}e^{y}", "e^{x+y}"),
    (r"\sin^2", r"\sin^2"), (r"\ln(x^2)", r"2\ln x"), ("2x+3y=6", "4x + 6y = 12"), ("12e2", "1200"), (r"\dfrac{3}{4}", ".75"), ("|{-3}|", "3"), ("5!", "120"), (r"x_1+x_2", r"x_2+x_1"),
    (r"\frac{\sqrt{3}}{3}", r"\frac{1}{\sqrt{3}}"), ("a(b+c)", "ab+ac"), ("$7$.", "7"),
]
OTHER = [
    (r"\frac12", "0.51"), ("(x+1)^2", "x^2+1"), ("(1,2)", "(2,1)"), ("[0,1)", "[0,1]"), (r"\{1,2\}", r"\{1,2,2\}"), ("x+1", "y+1"), (r"\sqrt{2}", "1.41421356"), (r"\pi", "3.14159"),
    ("5", ""), ("", ""), ("5", "Tuesday"), (r"x=\pm 2", "2"), ("2x+3y=6", "2x+3y=7"), (r"\infty", "5"), ("1/3", "0.333333333333"), ("10^{20}", "10^{20}+1"), ("(a+b)^{50}", "a^{50}+b^{50}"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same_answers(a, b):
    assert same(read(a), read(b)) and same(read(b), read(a))


@pytest.mark.parametrize("a,b", OTHER)
def test_other_answers(a, b):
    assert not same(read(a), read(b)) and not same(read(b), read(a))


def test_random_polynomials_expand():
    rng = random.Random(3)
    for _ in range(60):
        roots = [rng.randrange(-9, 10) for _ in range(rng.randrange(1, 5))]
        terms = [1]
        for r in roots:
            terms = [a - r * b for a, b in zip([*terms, 0], [0, *terms])]
        factored = "".join(f"(x-({r}))" for r in roots)
        degree = len(roots)
        expanded = "+".join(f"({c})x^{{{degree - k}}}" for k, c in enumerate(terms))
        assert same(read(factored), read(expanded))
        assert not same(read(factored), read(expanded + "+1"))


def test_statuses_and_errors():
    assert equivalent("1/2", r"so \boxed{\frac{2}{4}}", r"\frac{2}{4}") == (True, "symbolic_full")
    assert equivalent("7", r"\boxed{8} but $9$", "7.0") == (True, "symbolic_extracted")
    assert equivalent("7", "no number", None) == (False, "symbolic_full")
    assert equivalent("7", "the answer is 8", "8") == (False, "symbolic_extracted")
    assert equivalent(r"\frac{1}{0}", "1/0", "1/0") == (None, "symbolic_error:Undefined")
    assert equivalent("1" * 5000, "2", "2") == (None, "symbolic_error:TooLarge")
    assert equivalent("(" * 500 + "1" + ")" * 500, "2", "2") == (None, "symbolic_error:TooLarge")
    assert equivalent(None, "2", "2") == equivalent("2", None, None) == (False, "symbolic_full")


def test_the_prime_is_one():
    n, d, s = algebra.PRIME, algebra.PRIME - 1, 0
    assert n % 4 == 1
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(a, d, n)
        assert x in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(s - 1))


def test_scoring_with_symbols(spark):
    rows = [("math_500", "x^2+2x+1", r"\boxed{(x+1)^2}"), ("math_500", "1/2", r"\boxed{0.5}"), ("math_500", "1/2", "nothing"), ("math_500", r"\frac10", r"\boxed{3}"), ("math_500", None, r"\boxed{3}")]
    got = algebra.score(spark.createDataFrame(rows, "dataset string, canonical_answer string, raw_output string")).collect()
    assert [(r.canonical_match, r.parser_status, r.judge_required) for r in got] == [
        (True, "symbolic_full", True), (True, "symbolic_full", True), (False, "symbolic_full", False), (None, "symbolic_error:Undefined", True), (False, "symbolic_full", False),
    ]
