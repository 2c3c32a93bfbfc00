"""Gates a rewording must pass: numbers, symbols, units kept, wording changed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from robusteval import constants as C
from robusteval.functions.keys import as_column
from robusteval.functions.matching import ratio
from robusteval.functions.records import strip

#: A number does not start inside a word or another number.
_NUMBER = r"(?U)(?<![\w.])" + C.NUMBER


def numbers(text) -> Column:
    """Sorted numbers of a text, without separators and leading plus."""
    found = F.regexp_extract_all(as_column(text), F.lit(_NUMBER), F.lit(0))
    return F.array_sort(F.transform(found, lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"^\+", "")))


def symbols(text) -> Column:
    return F.array_sort(F.regexp_extract_all(as_column(text), F.lit(C.MATH_SYMBOL), F.lit(0)))


def units(text) -> Column:
    found = F.transform(F.regexp_extract_all(as_column(text), F.lit(C.WORD), F.lit(0)), F.lower)
    return F.array_sort(F.filter(found, lambda w: w.isin(*C.UNITS)))


def cleaned(rewording) -> Column:
    """Trimmed of white space, then of quotation marks, then again."""
    return strip(F.regexp_replace(strip(rewording), '^"+|"+$', ""))


def edit_ratio_distance(left: str, right: str) -> float:
    """One minus the matching-blocks ratio of lower-cased, space-normalized texts."""
    a, b = (" ".join(x.lower().split()) for x in (left, right))
    return 1.0 - ratio(a, b)


def edit_distance(original, rewording) -> Column:
    """The distance as an Arrow function: matching blocks have no SQL form. Both
    texts are read whole, one pair at a time: a batch's texts stay Arrow's until then."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = ((a.as_py(), b.as_py()) for a, b in zip(left, right))
        return pa.array([None if a is None or b is None else edit_ratio_distance(a, b) for a, b in pairs], pa.float64())

    return run(as_column(original), as_column(rewording))


def cheap_gates(original, rewording) -> dict[str, Column]:
    """The gates that need no distance."""
    clean = cleaned(rewording)
    return {
        "nonempty": clean != "",
        "number_multiset_match": numbers(original) == numbers(clean),
        "math_symbol_multiset_match": symbols(original) == symbols(clean),
        "unit_multiset_match": units(original) == units(clean),
    }


def passes_cheap(original, rewording) -> Column:
    out = F.lit(True)
    for gate in cheap_gates(original, rewording).values():
        out = out & gate
    return out
