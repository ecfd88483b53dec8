"""Column functions against hand-made expectations."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions import arrays as A
from docframe.functions import strings as S
from docframe.functions import values as V


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(cols)]).first()
    return r[0] if len(cols) == 1 else tuple(r)


def arr(*xs, kind="bigint"):
    return F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")


@pytest.mark.parametrize(
    "x, text",
    [(1.0, "1"), (100.0, "100"), (0.1 + 0.2, "0.30000000000000004"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (1e-6, "0.000001"), (-0.0, "0"), (-1.5, "-1.5"), (math.nan, "NaN"), (math.inf, "Infinity"), (1.5e300, "1.5e+300"), (123456.789, "123456.789")],
)
def test_number_text(x, text):
    assert V.number_text(x) == text


@pytest.mark.parametrize("x, d, text", [(1.005, 2, "1.00"), (2.5, 0, "3"), (-2.5, 0, "-3"), (1.45, 1, "1.4"), (0.0, 2, "0.00"), (1e21, 2, "1e+21"), (10.235, 2, "10.23"), (-0.0001, 2, "-0.00")])
def test_fixed_text(x, d, text):
    assert V.fixed_text(x, d) == text


def test_exponent_and_precision():
    assert [V.exponent_text(x) for x in (123456.0, 0.00015, 5.0, 0.0)] == ["1.23456e+5", "1.5e-4", "5e+0", "0e+0"]
    assert [V.exponent_text(x, 2) for x in (123456.0, 9.999, -0.5)] == ["1.23e+5", "1.00e+1", "-5.00e-1"]
    assert [V.precision_text(x, 3) for x in (123.456, 0.000001234, 123456.0, 1.0, 0.0, 0.0000001)] == ["123", "0.00000123", "1.23e+5", "1.00", "0.00", "1.00e-7"]


def test_number_columns(spark):
    d = T.DoubleType()
    df = spark.createDataFrame([(1.0,), (None,), (math.nan,), (1e21,)], "x double")
    assert [r[0] for r in df.select(V.number_string(F.col("x"), d)).collect()] == ["1", None, "NaN", "1e+21"]
    rng = random.Random(1)
    many = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-30, 30) for _ in range(500)] + [10.0**k for k in range(-9, 24)] + [2e23, 161304845894623140.0, 5097654563224752000.0, -0.0]
    found = spark.createDataFrame([(x,) for x in many], "x double").select("x", V.number_string(F.col("x"), d)).collect()
    assert all(float(b) == a for a, b in found)
    assert sum(b == V.number_text(a) for a, b in found) >= 0.99 * len(found)
    assert [r[0] for r in df.select(V.to_fixed(F.col("x"), 1)).collect()] == ["1.0", None, "NaN", "1e+21"]
    assert one(spark, V.to_radix(F.lit(255), 16), V.to_radix(F.lit(-255), 2)) == ("ff", "-11111111")
    s = T.StringType()
    values = ["12", " 1.5e2\n", "", None, "x", "0x10", "1d", "inf", "-Infinity", "NaN", ".5", "1."]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(V.to_number(F.col("x"), s)).collect()]
    assert got == [12, 150, 0, 0, 0, 16, 0, 0, -math.inf, 0, 0.5, 1]
    assert one(spark, V.to_number(F.lit(True), T.BooleanType()), V.to_number(F.lit(math.nan), d)) == (1, 0)


def test_truthy(spark):
    assert one(spark, *[V.truthy(F.lit(x).cast(k), t) for x, k, t in ((0, "int", T.IntegerType()), (5, "int", T.IntegerType()), (math.nan, "double", T.DoubleType()), ("", "string", T.StringType()), ("a", "string", T.StringType()), (None, "int", T.IntegerType()))]) == (False, True, False, False, True, False)


def test_text_of_values(spark):
    df = spark.createDataFrame([([[1, None], [2]], {"a": 1.0}, None, [1.0, 2.5])], "l array<array<int>>, o struct<a:double>, n string, d array<double>")
    kinds = {f.name: f.dataType for f in df.schema}
    r = df.select(*[V.string_of(F.col(c), k).alias(c) for c, k in kinds.items()]).first()
    assert tuple(r) == ("1,,2", "[object Object]", "null", "1,2.5")
    j = df.select(V.to_json_text(F.struct(*df.columns), df.schema)).first()[0]
    assert j == '{"l":[[1,null],[2]],"o":{"a":1},"n":null,"d":[1,2.5]}'
    assert df.select(V.pretty_json(F.lit('{"a":[1,2.50],"b":{},"c":"é"}'))).first()[0] == '{\n  "a": [\n    1,\n    2.5\n  ],\n  "b": {},\n  "c": "é"\n}'


def test_json_objects(spark):
    v = F.parse_json(F.lit('{"b":null,"a":[1],"10":2,"9":"x","o":{}}'))
    assert one(spark, V.json_keys(F.lit('{"b":null,"a":[1],"10":2,"9":"x","o":{}}'))) == ["9", "10", "b", "a", "o"]
    assert one(spark, V.has_key(v, "b"), V.has_key(v, "zz")) == (True, False)
    assert one(spark, *[V.json_type(F.variant_get(v, p, "variant")) for p in ("$.b", "$.a", "$['10']", "$['9']", "$.o", "$.zz")]) == ("null", "array", "number", "string", "object", None)


def test_array_positions(spark):
    a = arr(5, 6, 7, None)
    assert one(spark, A.slice_items(a, 1, 3), A.slice_items(a, -2), A.slice_items(a, 3, 1), A.slice_items(a, -9, 2)) == ([6, 7], [7, None], [], [5, 6])
    assert one(spark, A.at(a, 0), A.at(a, -2), A.at(a, 9), A.item(a, 1), A.item(a, 9)) == (5, 7, None, 6, None)
    assert one(spark, A.index_of(a, F.lit(None).cast("bigint")), A.index_of(a, F.lit(9)), A.last_index_of(arr(1, 2, 1), F.lit(1))) == (3, -1, 2)
    assert one(spark, A.index_of(arr(math.nan, 1.0, kind="double"), F.lit(math.nan), True), A.includes(arr(math.nan, kind="double"), F.lit(math.nan))) == (-1, True)


def test_array_folds(spark):
    a, e = arr(3, 10, 1, None), arr()
    assert one(spark, A.sort_as_text(a), A.sort_by(a, lambda x: x), A.sort_by(a, lambda x: x, True), A.top_k(a, lambda x: x, 2)) == ([1, 10, 3, None], [1, 3, 10, None], [10, 3, 1, None], [10, 3])
    assert one(spark, A.join_items(a, "-"), A.join_items(e), A.length(a)) == ("3-10-1-", "", 4)
    assert one(spark, A.some(e, lambda x: x > 0), A.every(e, lambda x: x > 0), A.some(a, lambda x: x > 5), A.every(a, lambda x: x > 0)) == (False, True, True, False)
    assert one(spark, A.find(a, lambda x: x < 5), A.find_index(a, lambda x: x > 50), A.filter_items(a, lambda x: x > 2)) == (3, -1, [3, 10])
    assert one(spark, A.reduce(arr(1, 2, 3), F.lit(0).cast("bigint"), lambda x, y: x * 10 + y), A.reduce_right(arr(1, 2, 3), F.lit(0).cast("bigint"), lambda x, y: x * 10 + y)) == (123, 321)
    with pytest.raises(Exception, match="empty array"):
        one(spark, A.reduce_first(e, lambda x, y: x + y))
    nested = F.array(arr(1), F.lit(None).cast("array<bigint>"), arr(2, None))
    assert one(spark, A.flat(nested), A.distinct(arr(2, 1, 2)), A.pop(e)[0], A.shift(arr(1, 2))[1], A.push(arr(1), F.lit(2).cast("bigint"))) == ([1, None, 2, None], [2, 1], None, [2], [1, 2])


def test_strings(spark):
    s = F.lit("a😀cß ")
    assert one(spark, S.length(s), S.length(s, utf16=True), S.trim(F.lit("﻿\t x \n ")), S.upper(F.lit("straße"))) == (5, 6, "x", "STRASSE")
    x = F.lit("hello world")
    assert one(spark, S.slice_text(x, -5), S.slice_text(x, 3, 1), S.slice_text(x, 2, -2), S.substring(x, 5, 2), S.substring(x, -3, 2)) == ("world", "", "llo wor", "llo", "he")
    assert one(spark, S.replace_first(x, "o", "0"), S.replace_all(x, "o", "0"), S.replace_first_match(x, "[lo]+", "<$&>"), S.replace_first(x, "zz", "0")) == ("hell0 world", "hell0 w0rld", "he<llo> world", "hello world")
    assert one(spark, S.split(F.lit("a,b,,"), ","), S.split(F.lit("a.b.c"), ".", 2), S.split(F.lit("abc"), "")) == (["a", "b", "", ""], ["a", "b"], ["a", "b", "c"])
    assert one(spark, S.index_of(x, "o"), S.last_index_of(x, "o"), S.last_index_of(x, "lo"), S.index_of(x, "z")) == (4, 7, 3, -1)
    assert one(spark, S.char_at(x, 99), S.char_at(x, -1), S.at(x, -1), S.at(x, 99)) == ("", "", "d", None)
    assert one(spark, S.pad_start(F.lit("abc"), 2, "x"), S.pad_start(F.lit("abc"), 6, "xy"), S.pad_end(F.lit("a"), 3, ""), S.repeat(F.lit("ab"), 0)) == ("abc", "xyxabc", "a", "")
    with pytest.raises(ValueError):
        S.repeat(x, -1)
    assert one(spark, S.match(x, "(l+)(o)", 2), S.match(x, "z"), S.match_each(x, "o."), S.match_each(x, "z")) == (["llo", "ll", "o"], None, ["o ", "or"], None)
    assert [tuple(r) for r in one(spark, S.match_all(F.lit("a1b2"), "([a-z])([0-9])", 2))] == [("a1", "a", "1"), ("b2", "b", "2")]
    assert one(spark, S.fill_template(F.lit("x {{a}} {{c}}"), {"a": "{{b}}", "b": "1"}), S.strip_fences(F.lit("```js\nlet a;\n```\n")), S.strip_fences(F.lit(" plain "))) == ("x 1 {{c}}", "let a;", "plain")
    assert S.fill_template_text("x {{a}} {{c}}", {"a": "{{b}}", "b": "1"}) == "x 1 {{c}}"
    df = spark.createDataFrame([(w,) for w in ("b", "A", "é", "a", "B", "f")], "w string")
    assert [r[0] for r in df.orderBy(S.locale_key(F.col("w"))).collect()] == ["a", "A", "b", "B", "é", "f"]
