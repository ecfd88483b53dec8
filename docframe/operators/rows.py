"""Array methods over the rows of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.values import string_of, truthy


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """One row for each row, with these columns (objects built, renamed or picked)."""
    return df.select(*[c.alias(k) for k, c in columns.items()])


def filter_rows(df: DataFrame, test: Column) -> DataFrame:
    """Rows for which test is truthy, of whatever type it is."""
    return df.where(truthy(test, df.select(test.alias("t")).schema["t"].dataType))


def concat_rows(*parts: DataFrame) -> DataFrame:
    """Rows of all, duplicates kept, columns by name (missing ones null), with the part's number as `_source`."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("_source", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def flat_rows(df: DataFrame, column: str) -> DataFrame:
    """A row for each item of an array column; empty arrays vanish, a null array stays as one null."""
    return df.withColumn(column, F.explode(F.coalesce(F.col(column), F.array(F.lit(None)))))


def push_rows(df: DataFrame, more: DataFrame) -> tuple[DataFrame, int]:
    """The dataset with rows at its end (`_source` 1), and its new length."""
    out = concat_rows(df, more)
    return out, out.count()


def unshift_rows(df: DataFrame, more: DataFrame) -> tuple[DataFrame, int]:
    """The dataset with rows in front (`_source` 0), and its new length."""
    out = concat_rows(more, df)
    return out, out.count()


def includes(df: DataFrame, column: str, value) -> DataFrame:
    """One row `includes`: null equals null; false for no rows."""
    return df.agg(F.coalesce(F.bool_or(F.col(column).eqNullSafe(F.lit(value))), F.lit(False)).alias("includes"))


def some(df: DataFrame, test: Column) -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(F.coalesce(test, F.lit(False))), F.lit(False)).alias("some"))


def every(df: DataFrame, test: Column) -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(F.coalesce(test, F.lit(False))), F.lit(True)).alias("every"))


def find(df: DataFrame, test: Column, order_by: list[Column]) -> DataFrame:
    """The first row that passes, or none."""
    return df.where(test).orderBy(*order_by).limit(1)


def find_index(df: DataFrame, test: Column, position: str = "_pos") -> DataFrame:
    """One row `index`: the first place that passes, or -1."""
    return df.agg(F.coalesce(F.min(F.when(test, F.col(position))), F.lit(-1)).cast("long").alias("index"))


def index_of(df: DataFrame, column: str, value, position: str = "_pos") -> DataFrame:
    return find_index(df, F.col(column).eqNullSafe(F.lit(value)), position)


def last_index_of(df: DataFrame, column: str, value, position: str = "_pos") -> DataFrame:
    same = F.col(column).eqNullSafe(F.lit(value))
    return df.agg(F.coalesce(F.max(F.when(same, F.col(position))), F.lit(-1)).cast("long").alias("index"))


def join_text(df: DataFrame, column: str, order_by: str, separator: str = ",") -> DataFrame:
    """One row `text`: the column's texts in order, nulls as ''. The order column is unique. For datasets whose text fits
    one row, as a joined text must."""
    item = F.struct(F.col(order_by).alias("o"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("t"))
    return df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["t"]), separator).alias("text"))


def distinct_rows(df: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """For each key its first row in the order."""
    rest = [c for c in df.columns if c not in keys]
    firsts = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order_by)).alias("_first"))
    return firsts.select(*keys, "_first.*")


def text_order(df: DataFrame, column: str) -> DataFrame:
    """The default sort of values: by their text."""
    return df.orderBy(string_of(F.col(column), df.schema[column].dataType), *[c for c in df.columns if c != column])
