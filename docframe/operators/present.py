"""Results as tables, CSV lines, raw text, statistics and chart series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions import values

_NESTED = (T.ArrayType, T.StructType, T.MapType)


def cell(value: Column, kind: T.DataType) -> Column:
    """A table cell: null as 'null', nested values as compact JSON, the rest as text."""
    return F.coalesce(values.to_json_text(value, kind), F.lit("null")) if isinstance(kind, _NESTED) else values.string_of(value, kind)


def table(df: DataFrame) -> DataFrame:
    """Typed rows as text cells, columns as they are."""
    return df.select(*[cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def primitives(df: DataFrame, column: str) -> DataFrame:
    """One column, Value."""
    return df.select(cell(F.col(column), df.schema[column].dataType).alias("Value"))


def header(df: DataFrame, text: str, order_by: Column, first: int | None = None, known: Sequence[str] = ()) -> list[str]:
    """Keys of a column of JSON objects in first-seen order; of the first rows of the order only, where `first` is given.
    Keys that are known beforehand come before the others, in the order given, whether or not any row has them; without
    them the order hangs on which keys the first rows lack. What is gathered is one row for each key."""
    rows = df.select(F.col(text).alias("t"), order_by.alias("o"))
    rows = rows.orderBy("o").limit(first) if first is not None else rows
    keys = rows.select("o", F.posexplode(values.json_keys(F.col("t"))).alias("k", "key")).groupBy("key").agg(F.min(F.struct("o", "k")).alias("at"))
    return list(dict.fromkeys([*known, *(r["key"] for r in keys.orderBy("at").collect())]))


def _values(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """A variant column _0, _1 .. for each key, from one parse of each text."""
    parsed = df.select(F.try_parse_json(F.col(text)).alias("_v"))
    place = lambda k: "$['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return parsed.select(*[F.try_variant_get("_v", place(k), "variant").alias(f"_{i}") for i, k in enumerate(keys)])


def _shown(got: Column, nested: Column) -> Column:
    """The text of a variant: JSON null as 'null', a missing one as ''; nested ones as given."""
    kind = values.json_type(got)
    number = values.number_string(F.try_variant_get(got, "$", "double"), T.DoubleType())
    return F.when(got.isNull(), "").when(kind == "null", "null").when(kind.isin("array", "object"), nested).when(kind == "number", number).otherwise(F.try_variant_get(got, "$", "string"))


def dynamic_table(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Cells of JSON texts by key: JSON null as 'null', a missing key as '', rows that are no objects as empty cells."""
    found = _values(df, text, keys)
    return found.select(*[_shown(F.col(f"_{i}"), F.to_json(f"_{i}")).alias(k) for i, k in enumerate(keys)])


def _quoted(text: Column) -> Column:
    return F.when(text.rlike(r'[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame) -> DataFrame:
    """CSV as rows of one column `value`: null as null, nested arrays comma-joined, objects as [object Object], cells with
    a comma, quote or line break quoted. The header line is csv_header."""
    cells = [_quoted(values.string_of(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields]
    return df.select(F.concat_ws(",", *cells).alias("value"))


def dynamic_csv_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The same for JSON texts by key: a missing key is an empty cell, JSON null is null. Items of nested arrays that are
    arrays themselves are joined as well, at one more depth."""
    found = _values(df, text, keys)

    def flat(got: Column, deeper: int) -> Column:
        """String(value): an array's items joined by commas with nulls as nothing, an object as [object Object]."""
        items = F.try_variant_get(got, "$", "array<variant>")
        inner = lambda x: F.when(values.json_type(x) == "null", "").otherwise(_shown(x, flat(x, deeper - 1) if deeper else F.to_json(x)))
        return F.when(values.json_type(got) == "array", F.array_join(F.transform(items, inner), ",")).otherwise(F.lit("[object Object]"))

    return found.select(F.concat_ws(",", *[_quoted(_shown(F.col(f"_{i}"), flat(F.col(f"_{i}"), 1))) for i in range(len(keys))]).alias("value"))


def csv_header(df: DataFrame) -> str:
    return ",".join(df.columns)


def copied_lines(df: DataFrame) -> DataFrame:
    """The visible cells joined by commas, nothing quoted."""
    shown = table(df)
    return shown.select(F.concat_ws(",", *[F.col(f"`{c}`") for c in shown.columns]).alias("value"))


def raw(df: DataFrame, column: str) -> DataFrame:
    return df.select(values.string_of(F.col(column), df.schema[column].dataType).alias("raw"))


def statistics(df: DataFrame) -> DataFrame:
    """One row: items, keys, lines and characters of the whole result as pretty JSON (an array of the rows)."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    text = values.pretty_json(values.to_json_text(row, T.StructType(df.schema.fields)))
    each = df.select(text.alias("t")).select((F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.length("t").alias("chars"))
    total = each.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("lines"), F.lit(0)).alias("l"), F.coalesce(F.sum("chars"), F.lit(0)).alias("c"))
    some = F.col("items") > 0
    return total.select(
        "items", F.lit(len(df.columns)).cast("long").alias("keys"), F.when(some, F.col("l") + 2).otherwise(1).cast("long").alias("lines"),
        F.when(some, F.col("c") + 2 * F.col("l") + (F.col("items") - 1) + (F.col("items") + 1) + 2).otherwise(2).cast("long").alias("chars"),
    )


def chart_series(df: DataFrame, position: str = "_pos") -> DataFrame:
    """(_pos, label, series, value): the label is the first string column, else the first; series are the numeric
    columns, else the second column (the first where there is one); values are read as numbers, 0 where they aren't."""
    fields = [f for f in df.schema.fields if f.name != position]
    label = next((f for f in fields if isinstance(f.dataType, T.StringType)), fields[0])
    series = [f for f in fields if isinstance(f.dataType, T.NumericType)] or [fields[min(1, len(fields) - 1)]]
    pairs = F.array(*[F.struct(F.lit(f.name).alias("series"), values.to_number(F.col(f"`{f.name}`"), f.dataType).alias("value")) for f in series])
    name = values.string_of(F.col(f"`{label.name}`"), label.dataType)
    return df.select(position, name.alias("label"), F.explode(pairs).alias("s")).select(position, "label", "s.series", "s.value")


def primitive_series(df: DataFrame, column: str, position: str = "_pos") -> DataFrame:
    """The same for primitives: the label is the place, the series is Value."""
    return df.select(position, F.col(position).cast("string").alias("label"), F.lit("Value").alias("series"), values.to_number(F.col(column), df.schema[column].dataType).alias("value"))
