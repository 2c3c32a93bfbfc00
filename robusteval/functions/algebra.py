"""Symbolic equivalence of answers.

An answer is read into a small tree: numbers, letters, sums, products, powers, roots,
functions; sets, tuples, intervals, unions and equations of these; or words. Trees are
compared as identities. Expressions of the four operations and whole powers are
evaluated at random points modulo a prime, where different polynomials or fractions
agree with a chance of about degree / 2**61 a point (the imaginary unit is a root of
minus one there); others at random points in decimal arithmetic of 60 digits. Sets
and unions match in any order, tuples and intervals place by place and end by end.

Defined results: what can't be read matches nothing but the same words; a null gold
answer or output matches nothing; an expression without a value (division by zero, an
infinite difference) and one too long or too deep leave the match open, with the error
named in the status.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal, InvalidOperation, Overflow, localcontext
from fractions import Fraction
from functools import lru_cache
from random import Random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval.functions import answers

#: A prime that is one more than a multiple of four (fixed value).
PRIME = 2**61 - 31
POINTS, LONGEST, DEEPEST, DIGITS = 3, 4_000, 60, 60
#: Characters of two answers whose comparison is remembered.
REMEMBERED = 200
PI = Decimal("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899")
#: Letters side by side that are a product; longer ones are a word.
SHORT = 3
FUNCTIONS = ("sin", "cos", "tan", "ln", "log", "exp")
_OPEN, _CLOSE = {"(": ")", "[": "]"}, ")]"
_TOKEN = re.compile(r"\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?|\.\d+|\\[A-Za-z]+|\\.|[A-Za-z]{2,}|\S")
_NOISE = re.compile(r"\\(?:left|right|displaystyle|quad|qquad|limits)(?![A-Za-z])|\\[,;:! ()\[\]]|\^\s*\{?\s*\\circ\s*\}?|°|\$|~")
_TEXT = re.compile(r"\\(?:text|mathrm|mbox|textbf)\s*\{([^{}]*)\}")
_UNIT = re.compile(r"(?<=[\d}\s])(?:" + "|".join(sorted(map(re.escape, C.UNITS), key=len, reverse=True)) + r")\b\.?\s*$", re.IGNORECASE)
_THOUSANDS = re.compile(r"[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?%?")
_FORMULA = re.compile(r"\$([^$]+)\$")
_BOXED, _PHRASE, _NUMBER = re.compile(r"\\boxed\s*\{", re.IGNORECASE), re.compile(C.ANSWER_PHRASE), re.compile(C.NUMBER)

Node = tuple


class Unread(ValueError):
    """Not an expression."""


class TooLarge(ValueError):
    """Longer or deeper than is read."""


class Undefined(ArithmeticError):
    """No value at any point."""


class _Other(ArithmeticError):
    """A value that is no residue: roots, functions, pi."""


class Reader:
    """Recursive descent over the tokens of one answer."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        token = self.peek()
        if not token or (wanted and token != wanted):
            raise Unread(f"{wanted or 'more'} expected")
        self.at += 1
        return token

    def whole(self) -> Node:
        node = self.relation()
        if self.peek() == ",":
            node = ("set", (node, *self.rest_of_list()))
        if self.peek():
            raise Unread(self.peek())
        return node

    def rest_of_list(self) -> list[Node]:
        out = []
        while self.peek() == ",":
            self.take()
            out.append(self.relation())
        return out

    def relation(self) -> Node:
        left = self.union()
        if self.peek() in ("=", r"\in"):
            sign = self.take()
            right = self.union()
            # a name only says what the answer is called
            return right if left[0] == "name" or sign != "=" else ("equation", left, right)
        return left

    def union(self) -> Node:
        parts = [self.sum()]
        while self.peek() in (r"\cup", "∪"):
            self.take()
            parts.append(self.sum())
        return parts[0] if len(parts) == 1 else ("union", tuple(parts))

    def sum(self) -> Node:
        self.depth += 1
        if self.depth > DEEPEST:
            raise TooLarge
        node = self.product()
        while self.peek() in ("+", "-", "−"):
            minus = self.take() != "+"
            right = self.product()
            node = ("+", node, ("*", ("number", Fraction(-1)), right) if minus else right)
        self.depth -= 1
        return node

    def product(self) -> Node:
        node = self.signed()
        while True:
            token = self.peek()
            if token in ("*", "×", "·", r"\cdot", r"\times"):
                self.take()
                node = ("*", node, self.signed())
            elif token in ("/", "÷", r"\div"):
                self.take()
                node = ("/", node, self.signed())
            elif token and (token[0].isalnum() or token[0] in ".(\\{π√") and token not in (r"\cup", r"\in", r"\}", r"\|"):
                right = self.power()
                mixed = node[0] == "number" and node[1].denominator == 1 and right[0] == "/" and right[1][0] == right[2][0] == "number"
                node = ("+" if mixed else "*", node, right)
            else:
                return node

    def signed(self) -> Node:
        if self.peek() in ("-", "−", "+"):
            minus = self.take() != "+"
            node = self.signed()
            return ("*", ("number", Fraction(-1)), node) if minus else node
        return self.power()

    def power(self) -> Node:
        node = self.atom()
        while self.peek() in ("%", r"\%", "!"):
            sign = self.take()
            node = ("factorial", node) if sign == "!" else ("/", node, ("number", Fraction(100)))
        if self.peek() == "^":
            self.take()
            node = ("^", node, self.group())
        return node

    def group(self) -> Node:
        """A braced expression, or one sign: of a number its first digit."""
        token = self.peek()
        if token == "{":
            self.take()
            node = self.sum()
            self.take("}")
            return node
        if token[:1].isdigit() and len(token) > 1:
            self.tokens[self.at] = token[1:]
            return ("number", Fraction(token[0]))
        return self.signed()

    def atom(self) -> Node:
        token = self.take()
        if token[0].isdigit() or token[0] == ".":
            return ("number", number(token))
        if token in (r"\frac", r"\dfrac", r"\tfrac", r"\cfrac"):
            return ("/", self.group(), self.group())
        if token in (r"\sqrt", "√"):
            degree: Node = ("number", Fraction(2))
            if self.peek() == "[":
                self.take()
                degree = self.sum()
                self.take("]")
            return ("^", self.group(), ("/", ("number", Fraction(1)), degree))
        if token in _OPEN:
            return self.bracketed(token)
        if token == "{":
            node = self.sum()
            self.take("}")
            return node
        if token == r"\{":
            items = [] if self.peek() == r"\}" else [self.relation(), *self.rest_of_list()]
            self.take(r"\}")
            return ("set", tuple(items))
        if token == "|":
            node = self.sum()
            self.take("|")
            return ("abs", node)
        name = token.lstrip("\\")
        if name in FUNCTIONS:
            return ("function", name, self.power())
        if name in ("infty", "∞"):
            return ("infinity",)
        if name in ("pi", "π"):
            return ("pi",)
        if name in ("emptyset", "varnothing"):
            return ("set", ())
        if token.startswith("\\") and token[1:].isalpha() or len(token) == 1 and token.isalpha():
            if self.peek() == "_":
                self.take()
                name += str(self.group())
            return ("name", name)
        if token.isalpha() and len(token) <= SHORT:
            node = ("name", token[0])
            for letter in token[1:]:
                node = ("*", node, ("name", letter))
            return node
        raise Unread(token)

    def bracketed(self, opened: str) -> Node:
        items = [self.relation(), *self.rest_of_list()]
        closed = self.take()
        if closed not in _CLOSE:
            raise Unread(closed)
        if len(items) == 1 and closed == _OPEN[opened]:
            return items[0]
        return ("tuple", opened, closed, tuple(items))


def number(token: str) -> Fraction:
    plain = token.replace("_", "")
    if re.search(r"[eE][-+]?\d{4}", plain):
        raise TooLarge
    return Fraction(plain)


@lru_cache(maxsize=20_000)
def read(answer: str) -> Node:
    """The tree of an answer; words where it is no expression."""
    if len(answer) > LONGEST:
        raise TooLarge
    text = _TEXT.sub(lambda m: m[1] if any(c.isdigit() for c in m[1]) or answer.strip() == m[0] else " ", answer)
    text = _UNIT.sub("", _NOISE.sub(" ", text).strip().rstrip(". "))
    if _THOUSANDS.fullmatch(text):
        text = text.replace(",", "")
    try:
        if "\\pm" in text or "±" in text:
            both = [re.sub(r"\\pm(?![a-z])|±", sign, text) for sign in "+-"]
            return ("set", tuple(Reader(_TOKEN.findall(t)).whole() for t in both))
        return Reader(_TOKEN.findall(text)).whole()
    except (Unread, RecursionError):
        return ("words", " ".join(text.lower().split()))


def final_answer(output: str) -> str | None:
    """What a whole output gives as its answer: the last closed box, what the last
    answer phrase says, the last formula, the last number."""
    for begin in [m.end() for m in _BOXED.finditer(output)][-1:]:
        depth = 1
        for k in range(begin, len(output)):
            depth += (output[k] == "{") - (output[k] == "}")
            if not depth:
                return output[begin:k]
    for pattern, group in ((_PHRASE, 1), (_FORMULA, 1), (_NUMBER, 0)):
        found = None
        for found in pattern.finditer(output):
            pass
        if found:
            return found[group]
    return None


def residue(node: Node, point: Callable[[str], int]) -> int:
    """A tree's value modulo the prime."""
    kind = node[0]
    if kind == "number":
        return node[1].numerator * pow(node[1].denominator, -1, PRIME) % PRIME
    if kind == "name":
        return point(node[1])
    if kind == "^":
        exponent = constant(node[2])
        if exponent is None or exponent.denominator != 1 or abs(exponent) > 10**6:
            raise _Other
        base = residue(node[1], point)
        if exponent < 0 and base == 0:
            raise ZeroDivisionError
        return pow(base, int(exponent), PRIME)
    if kind in "+*/":
        a, b = residue(node[1], point), residue(node[2], point)
        if kind == "/":
            if b == 0:
                raise ZeroDivisionError
            return a * pow(b, -1, PRIME) % PRIME
        return (a + b if kind == "+" else a * b) % PRIME
    raise _Other


def constant(node: Node) -> Fraction | None:
    """The value of a tree of numbers alone under the four operations."""
    if node[0] == "number":
        return node[1]
    if node[0] not in ("+", "*", "/"):
        return None
    a, b = constant(node[1]), constant(node[2])
    if a is None or b is None or (node[0] == "/" and b == 0):
        return None
    return a + b if node[0] == "+" else a * b if node[0] == "*" else a / b


def series(x: Decimal, first: int) -> Decimal:
    """Cosine (first 0) or sine (1) by its series, after the turns are taken off."""
    x = x % (2 * PI)
    term = x**first if first else Decimal(1)
    total, k = term, first
    while abs(term) > Decimal(10) ** -(DIGITS + 5):
        term = -term * x * x / ((k + 1) * (k + 2))
        total, k = total + term, k + 2
    return total


def decimal_value(node: Node, point: Callable[[str], Decimal]) -> Decimal:
    """A tree's value in decimal arithmetic."""
    kind = node[0]
    if kind == "number":
        return Decimal(node[1].numerator) / node[1].denominator
    if kind == "name":
        return point(node[1])
    if kind == "pi":
        return PI
    if kind == "infinity":
        return Decimal("Infinity")
    if kind in ("abs", "factorial", "function"):
        x = decimal_value(node[-1], point)
        if kind == "abs":
            return abs(x)
        if kind == "factorial":
            if x != int(x) or not 0 <= x <= 1000:
                raise InvalidOperation
            out = Decimal(1)
            for k in range(2, int(x) + 1):
                out *= k
            return out
        name = node[1]
        if name in ("sin", "cos", "tan"):
            sine, cosine = series(x, 1), series(x, 0)
            return sine if name == "sin" else cosine if name == "cos" else sine / cosine
        return x.exp() if name == "exp" else x.log10() if name == "log" else x.ln()
    a, b = decimal_value(node[1], point), decimal_value(node[2], point)
    if kind == "^":
        exponent = constant(node[2])
        if a < 0 and exponent is not None and exponent.denominator % 2:
            # the real root of a negative number
            size = (-a) ** (Decimal(exponent.numerator) / exponent.denominator)
            return -size if exponent.numerator % 2 else size
        return a**b
    return a + b if kind == "+" else a * b if kind == "*" else a / b


ROOT_OF_MINUS_ONE = next(r for r in (pow(a, (PRIME - 1) // 4, PRIME) for a in range(2, 100)) if r * r % PRIME == PRIME - 1)


def identical(a: Node, b: Node) -> bool:
    """Whether two expressions have the same value at random points."""
    if "infinity" in (a[0], b[0]):
        return a == b
    defined = 0
    for k in range(POINTS):
        try:
            point = lambda name: ROOT_OF_MINUS_ONE if name == "i" else Random(f"{k}:{name}").randrange(PRIME)
            if residue(a, point) != residue(b, point):
                return False
        except ZeroDivisionError:
            continue
        except _Other:
            with localcontext() as context:
                context.prec = DIGITS
                place = lambda name: 1 + Decimal(Random(f"{k}:{name}").randrange(10**12)) / 10**12
                try:
                    x, y = decimal_value(a, place), decimal_value(b, place)
                    if x.is_infinite() or y.is_infinite():
                        if x != y:
                            return False
                    elif abs(x - y) > Decimal(10) ** -(DIGITS // 2) * max(1, abs(x), abs(y)):
                        return False
                except (InvalidOperation, Overflow, ZeroDivisionError, ValueError):
                    continue
        defined += 1
    if not defined:
        raise Undefined
    return True


def matched(left: tuple[Node, ...], right: tuple[Node, ...]) -> bool:
    """Whether each of one list is some other of the second, in any order."""
    rest = list(right)
    for x in left:
        at = next((k for k, y in enumerate(rest) if same(x, y)), None)
        if at is None:
            return False
        rest.pop(at)
    return not rest


def same(a: Node, b: Node) -> bool:
    """Whether two trees are the same answer."""
    groups = ("set", "union", "tuple", "words", "equation")
    if a[0] in groups or b[0] in groups:
        if a[0] != b[0]:
            lone = a if a[0] == "set" else b
            return lone[0] == "set" and len(lone[1]) == 1 and same(lone[1][0], b if lone is a else a)
        if a[0] == "words":
            return a == b and a[1] != ""
        if a[0] == "tuple":
            return a[1:3] == b[1:3] and len(a[3]) == len(b[3]) and all(map(same, a[3], b[3]))
        if a[0] == "equation":
            minus = lambda e: ("+", e[1], ("*", ("number", Fraction(-1)), e[2]))
            zero = ("number", Fraction(0))
            if identical(minus(a), zero) or identical(minus(b), zero):
                return identical(minus(a), minus(b))
            ratio = ("/", minus(a), minus(b))
            return any(identical(ratio, ("number", Fraction(v))) for v in (1, -1)) or constant_ratio(ratio)
        return matched(a[1], b[1])
    return identical(a, b)


def constant_ratio(ratio: Node) -> bool:
    """Whether a quotient has one value at all points."""
    try:
        found = {residue(ratio, lambda name: ROOT_OF_MINUS_ONE if name == "i" else Random(f"{k}:{name}").randrange(PRIME)) for k in range(POINTS)}  # noqa: B023
    except (ZeroDivisionError, _Other):
        return False
    return len(found) == 1


@lru_cache(maxsize=50_000)
def _agree(gold: str, answer: str) -> bool:
    return same(read(gold), read(answer))


def agree(gold: str, answer: str) -> bool:
    """Whether two answers are the same one. Short ones recur, so they are remembered."""
    return _agree(gold, answer) if len(gold) + len(answer) <= REMEMBERED else same(read(gold), read(answer))


def equivalent(gold: str | None, output: str | None, extracted: str | None) -> tuple[bool | None, str]:
    """(match, status): the whole output counts if its answer matches, else what was
    extracted from it does."""
    if gold is None or output is None:
        return False, "symbolic_full"
    try:
        read(gold)
        told = final_answer(output)
        if told is not None and agree(gold, told):
            return True, "symbolic_full"
        if extracted is not None:
            return agree(gold, extracted), "symbolic_extracted"
        return False, "symbolic_full"
    except (TooLarge, Undefined) as error:
        return None, f"symbolic_error:{type(error).__name__}"


def equivalence(gold: Column, output: Column, extracted: Column) -> Column:
    """struct(match, status) of every row."""

    @F.pandas_udf("match boolean, status string")
    def run(golds: pd.Series, outputs: pd.Series, found: pd.Series) -> pd.DataFrame:
        given = [[x if isinstance(x, str) else None for x in column] for column in (golds, outputs, found)]
        rows = list(map(equivalent, *given))
        return pd.DataFrame({"match": pd.array([m for m, _ in rows], "boolean"), "status": [s for _, s in rows]})

    return run(gold, output, extracted)


def score(df: DataFrame) -> DataFrame:
    """answers.score with symbolic equivalence as its last layer."""
    rows = answers.held(df, answers.extraction("raw_output", "dataset"), "__found")
    rows = rows.withColumn("__symbolic", equivalence(F.col("canonical_answer"), F.col("raw_output"), F.col("__found.answer")))
    return answers.score(rows, lambda *_: F.col("__symbolic"), found=F.col("__found")).drop("__symbolic", "__found")
