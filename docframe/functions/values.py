"""Values: truth, numbers as text, coercion, objects and JSON text, with the semantics that JSON users know."""

from __future__ import annotations

import json
import math
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that text functions and number coercion trim.
WHITE = r"[\t\n\x0B\f\r    -     　﻿]+"

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def truthy(value: Column, kind: T.DataType) -> Column:
    """False for null, false, 0, NaN and the empty string; true for the rest. Never null."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce((value != 0) & ~F.isnan(value), F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(value != 0, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(value != "", F.lit(False))
    return value.isNotNull()


def number_text(x: float) -> str:
    """The shortest text that reads back as x: exponents only from 1e21 on and below 1e-6."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    body, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        text = body + "0" * (point - len(body)) if point >= len(body) else f"{body[:point]}.{body[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + body
    else:
        text = f"{body[0]}{'.' + body[1:] if len(body) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" + text if sign else text


def fixed_text(x: float, places: int) -> str:
    """x with so many decimals; ties of the exact binary value go away from zero."""
    if math.isnan(x) or math.isinf(x) or abs(x) >= 1e21:
        return number_text(x)
    with localcontext() as c:
        c.prec = 400
        text = format(Decimal(x).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP), "f")
    return text[1:] if text.startswith("-") and x == 0 else text


def exponent_text(x: float, places: int | None = None) -> str:
    """One digit, decimals (as many as needed, or so many), and an exponent with its sign."""
    if math.isnan(x) or math.isinf(x):
        return number_text(x)
    if x == 0:
        return "0" + ("." + "0" * places if places else "") + "e+0"
    exact = Decimal(repr(x)).normalize() if places is None else Decimal(x)
    with localcontext() as c:
        c.prec = 800
        power = exact.adjusted()
        if places is not None:
            exact = exact.quantize(Decimal(1).scaleb(power - places), rounding=ROUND_HALF_UP)
            power = exact.adjusted()
            exact = exact.quantize(Decimal(1).scaleb(power - places), rounding=ROUND_HALF_UP)
    sign, digits, _ = exact.as_tuple()
    body = "".join(map(str, digits))
    return f"{'-' if sign else ''}{body[0]}{'.' + body[1:] if len(body) > 1 else ''}e{'+' if power >= 0 else '-'}{abs(power)}"


def precision_text(x: float, digits: int) -> str:
    """x with so many significant digits, with an exponent where it is under -6 or not under `digits`."""
    if math.isnan(x) or math.isinf(x):
        return number_text(x)
    if x == 0:
        return fixed_text(0.0, digits - 1)
    text = exponent_text(x, digits - 1)
    power = int(text.partition("e")[2])
    return text if power < -6 or power >= digits else fixed_text(x, digits - 1 - power)


def _vectorised(f) -> Column:
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else f(x), na_action=None)

    return run


def number_string(value: Column, kind: T.DataType) -> Column:
    """A number's text, as number_text has it, in built-in functions; null stays null. It reads back as the same number;
    before Java 19 the last of 17 digits is another one for a few numbers in ten thousand."""
    if isinstance(kind, _INTEGERS):
        return value.cast("string")
    x = value.cast("double")
    text = F.abs(x).cast("string")
    # some runtimes write more digits than it takes to read back as the same number
    fewer = [F.upper(F.format_string(f"%.{n}e", F.abs(x))) for n in (15, 16)]
    same = [(F.length(text) >= 17) & (t.try_cast("double") == F.abs(x)) for t in fewer]
    text = F.when(same[0], fewer[0]).when(same[1], fewer[1]).otherwise(text)
    # digits and the place of the point, from a text such as 1.25E-7
    power = F.substring_index(text, "E", -1).cast("int")
    digits = F.regexp_replace(F.replace(F.substring_index(text, "E", 1), F.lit("."), F.lit("")), "(?<=.)0+$", "")
    point, n = power + 1, F.length(digits)
    scientific = F.concat(
        F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""),
        F.when(power > 0, "e+").otherwise("e-"), F.abs(power).cast("string"),
    )
    plain = F.when(n <= point, F.rpad(digits, point, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    spread = F.when((point > 0) & (point <= 21), plain).when((point > -6) & (point <= 0), small).otherwise(scientific)
    body = F.when(text.contains("E"), spread).otherwise(F.regexp_replace(text, r"\.0$", ""))
    signed = F.when(x < 0, F.concat(F.lit("-"), body)).otherwise(body)
    infinite = F.when(x > 0, "Infinity").otherwise("-Infinity")
    return F.when(value.isNull(), None).when(F.isnan(x), "NaN").when(x == 0, "0").when(F.abs(x) == float("inf"), infinite).otherwise(signed)


def to_fixed(value: Column, places: int) -> Column:
    return F.when(value.isNull(), None).when(F.isnan(value.cast("double")), "NaN").otherwise(_vectorised(lambda x: None if pd.isna(x) else fixed_text(x, places))(value.cast("double")))


def to_exponential(value: Column, places: int | None = None) -> Column:
    return F.when(value.isNull(), None).when(F.isnan(value.cast("double")), "NaN").otherwise(_vectorised(lambda x: None if pd.isna(x) else exponent_text(x, places))(value.cast("double")))


def to_precision(value: Column, digits: int) -> Column:
    return F.when(value.isNull(), None).when(F.isnan(value.cast("double")), "NaN").otherwise(_vectorised(lambda x: None if pd.isna(x) else precision_text(x, digits))(value.cast("double")))


def to_radix(value: Column, radix: int) -> Column:
    """An integer's text in another base, lower-case, with its sign."""
    text = F.lower(F.conv(F.abs(value).cast("string"), 10, radix))
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def _of_base(digits: Column, base: int) -> Column:
    """The double of an unsigned integer's digits: exact up to 52 bits, and within rounding beyond."""
    place = lambda d: F.call_function("locate", d, F.lit("0123456789abcdef")) - 1
    return F.aggregate(F.split(digits, "(?!^)(?!$)"), F.lit(0.0), lambda total, d: total * base + place(d))


def to_number(value: Column, kind: T.DataType) -> Column:
    """The number that a value reads as, and 0 where it reads as none: white space is trimmed, '' and null are 0, true is
    1, 0x, 0o and 0b begin hexadecimal, octal and binary digits, Infinity is read."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value.cast("double"), F.lit(0.0))
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    if not isinstance(kind, T.StringType):
        return F.lit(0.0)
    text = F.regexp_replace(F.regexp_replace(value, f"^{WHITE}", ""), rf"{WHITE}\z", "")
    decimal = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z")
    infinite = text.rlike(r"^[+-]?Infinity\z")
    number = F.when(decimal, text.try_cast("double")).when(infinite, F.when(text.startswith("-"), float("-inf")).otherwise(float("inf")))
    for base, sign, digit in ((16, "xX", "0-9a-fA-F"), (8, "oO", "0-7"), (2, "bB", "01")):
        number = number.when(text.rlike(rf"^0[{sign}][{digit}]+\z"), _of_base(F.lower(F.substring(text, F.lit(3), F.length(text))), base))
    return F.coalesce(number, F.lit(0.0))


def string_of(value: Column, kind: T.DataType, null: str = "null") -> Column:
    """The text of any value: arrays comma-joined at every depth with nulls as nothing, objects as [object Object]."""
    if isinstance(kind, T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, T.NumericType):
        text = number_string(value, kind)
    elif isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(value, lambda x: string_of(x, kind.elementType, "")), ",", "")
    elif isinstance(kind, (T.StructType, T.MapType)):
        text = F.when(value.isNotNull(), "[object Object]")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(null))


def json_keys(text: Column) -> Column:
    """An object's keys from its JSON text: integer-like ones first, rising, then the others in their order, each once."""
    keys = F.array_distinct(F.json_object_keys(text))
    number = lambda k: k.rlike(r"^(0|[1-9]\d{0,9})$")
    first = F.array_sort(F.transform(F.filter(keys, number), lambda k: F.struct(k.cast("long").alias("n"), k.alias("k"))))
    return F.concat(F.transform(first, lambda s: s["k"]), F.filter(keys, lambda k: ~number(k)))


def json_type(value: Column) -> Column:
    """null, array, object, string, number or boolean, of a variant; a missing value is null (SQL)."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "VOID", "null").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name.isNotNull(), "number")
    )


def has_key(value: Column, key: str) -> Column:
    """Whether a variant object has the key, be its value null."""
    return F.coalesce(F.variant_get(value, f"$.{key}", "variant").isNotNull(), F.lit(False))


def _quoted_json(value: Column) -> Column:
    """JSON of a string, date or other value that has no parts."""
    text = F.to_json(F.array(value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _json(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.BooleanType, *_INTEGERS)):
        text = value.cast("string")
    elif isinstance(kind, T.NumericType):
        x = value.cast("double")
        text = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), number_string(value, kind))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        each = F.transform(F.map_entries(value), lambda e: F.concat(_quoted_json(e["key"].cast("string")), F.lit(":"), _json(e["value"], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        parts = [x for k, f in enumerate(kind.fields) for x in (F.lit("," * (k > 0) + json.dumps(f.name, ensure_ascii=False) + ":"), _json(value.getField(f.name), f.dataType))]
        text = F.when(value.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    elif isinstance(kind, T.VariantType):
        text = F.to_json(value)
    else:
        text = F.when(value.isNotNull(), _quoted_json(value))
    return F.coalesce(text, F.lit("null"))


def to_json_text(value: Column, kind: T.DataType) -> Column:
    """Compact JSON of a struct, map or array, put together by type: nulls are written, numbers that are none become null,
    the others have the text of number_string; what stands in strings is never touched."""
    return F.when(value.isNotNull(), _json(value, kind))


@F.pandas_udf(T.StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON text indented by two spaces."""

    def one(t):
        if t is None:
            return None
        value = json.loads(t, parse_float=_Number, parse_int=_Number)
        return _pretty(value, "")

    return text.map(one)


class _Number(str):
    """A number as it was written."""


def _pretty(value, indent: str) -> str:
    deeper = indent + "  "
    if isinstance(value, _Number):
        return number_text(float(value)) if any(c in value for c in ".eE") else str(value)
    if isinstance(value, dict):
        items = [f"{json.dumps(k, ensure_ascii=False)}: {_pretty(v, deeper)}" for k, v in value.items()]
        return "{\n" + ",\n".join(deeper + x for x in items) + f"\n{indent}}}" if items else "{}"
    if isinstance(value, list):
        return "[\n" + ",\n".join(deeper + _pretty(x, deeper) for x in value) + f"\n{indent}]" if value else "[]"
    return json.dumps(value, ensure_ascii=False)
