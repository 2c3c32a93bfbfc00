"""Keys, digests and seeds as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from robusteval import constants as C


def as_column(x) -> Column:
    """A column by name, a column, or a constant."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def text_of(x) -> Column:
    return as_column(x).cast("string")


def sha256_text(x) -> Column:
    return F.sha2(text_of(x), 256)


def stable_seed(*parts) -> Column:
    """31-bit seed from the first four bytes of the parts' digest."""
    joined = F.concat_ws("\x1f", *[text_of(p) for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def stable_seed_value(*parts) -> int:
    """The same for values of the driver."""
    return int.from_bytes(hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()[:4], "big") & 0x7FFFFFFF


def hash_order(seed, *parts) -> Column:
    """A sort key: the digest of seed and parts."""
    return F.sha2(F.concat_ws(":", text_of(seed), *[text_of(p) for p in parts]), 256)


def record_key() -> Column:
    """The six key fields as strings; a missing column is an error of analysis."""
    return F.struct(*[F.col(c).cast("string").alias(c) for c in C.KEY])


def canonical_json(value) -> str:
    """One line of JSON with sorted keys, as digests are taken of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def object_fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def shortest_float(x: Column) -> Column:
    """A double as the standard library writes it: the shortest digits that read back
    as the same number, in scientific form below 1e-4 and from 1e16 on."""
    text = F.abs(x).cast("string")
    whole, rest = F.regexp_extract(text, r"^(\d+)\.(\d+)", 1), F.regexp_extract(text, r"^(\d+)\.(\d+)", 2)
    power = F.coalesce(F.try_to_number(F.regexp_extract(text, r"E(-?\d+)$", 1), F.lit("S999")).cast("int"), F.lit(0))

    def shown(p: Column) -> Column:
        lead = F.length(p["all"]) - F.length(F.regexp_replace(p["all"], "^0+", ""))
        digits = F.regexp_replace(F.regexp_replace(p["all"], "^0+", ""), "0+$", "")
        return then(then(then(F.struct(digits.alias("d"), (p["at"] - lead).alias("at")), fewer), fewer), written)

    def then(value: Column, step) -> Column:
        return F.transform(F.array(value), step)[0]

    def fewer(p: Column) -> Column:
        """One digit less, if that reads back as the same number: the text that a double
        is cast to may have a digit or two too many."""
        n = F.length(p["d"]) - 1
        up = F.when(F.substring(p["d"], -1, 1) >= "5", 1).otherwise(0)
        whole = F.when(n > 0, (F.substr(p["d"], F.lit(1), n).try_cast("decimal(38,0)") + up).cast("decimal(38,0)").cast("string")).otherwise(up.cast("string"))
        less = F.struct(F.regexp_replace(whole, "0+$", "").alias("d"), (p["at"] + F.length(whole) - n).alias("at"))
        back = lambda c: F.concat(F.lit("0."), c["d"], F.lit("E"), c["at"].cast("string")).try_cast("double") == F.abs(x)
        return then(less, lambda c: F.when((n > 0) & (c["d"] != "") & F.coalesce(back(c), F.lit(False)), c).otherwise(p))

    def written(p: Column) -> Column:
        d, at = p["d"], p["at"]
        padded = F.rpad(d, F.greatest(F.length(d), at + 1), F.lit("0"))
        fixed = F.when(at <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), d)).otherwise(F.concat(F.substr(padded, F.lit(1), at), F.lit("."), F.substr(padded, at + 1)))
        tail = F.when(F.length(d) > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise("")
        short = F.concat(F.substring(d, 1, 1), tail, F.lit("e"), F.when(at < 1, "-").otherwise("+"), F.lpad(F.abs(at - 1).cast("string"), F.greatest(F.lit(2), F.length(F.abs(at - 1).cast("string"))), F.lit("0")))
        return F.when(d == "", "0.0").when((at > -4) & (at <= 16), fixed).otherwise(short)

    found = F.transform(F.array(F.struct(F.concat(whole, rest).alias("all"), (F.length(whole) + power).alias("at"))), shown)[0]
    minus = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.concat(minus, found)


def quoted(x: Column) -> Column:
    """A string in JSON: quotes, backslashes and control characters escaped, all else kept."""
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    plain = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controls = plain
    for code in range(32):
        controls = F.replace(controls, F.lit(chr(code)), F.lit(f"\\{short[code]}" if code in short else f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[\x00-\x1F]"), controls).otherwise(plain), F.lit('"'))


def as_json(x: Column, kind: T.DataType) -> Column:
    """A value of any type as one line of JSON with sorted keys; a double that is no
    number, and a null, are null."""
    if isinstance(kind, T.StructType):
        fields = [F.concat(quoted(F.lit(f.name)), F.lit(":"), as_json(x[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: as_json(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].cast("string").alias("key"), as_json(e["value"], kind.valueType).alias("value"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), shortest_float(x.cast("double")))
    elif isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        out = x.cast("string")
    else:
        out = quoted(x.cast("string"))
    return F.coalesce(out, F.lit("null"))


def canonical_row_json(df: DataFrame, names: list[str]) -> Column:
    """The columns of a table as canonical JSON, nested ones included."""
    kinds = T.StructType([df.schema[n] for n in names])
    return as_json(F.struct(*names), kinds)


def cleaned(x: Column, kind: T.DataType) -> Column:
    """A value of any type with its NaN and infinite numbers as nulls."""
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[cleaned(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: cleaned(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: cleaned(v, kind.valueType))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return x


def immutable_revision(revision) -> Column:
    """Whether a revision is pinned: 40 lower-case hexadecimal digits."""
    return F.coalesce(as_column(revision).rlike(C.REVISION), F.lit(False))
