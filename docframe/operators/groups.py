"""Grouping and windows: what is usually written as a reduce over the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row: n, total, least, most, mean; of no rows nulls and n 0."""
    c = F.col(column)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"))


def group_items(df: DataFrame, keys: list[str], order_by: list[str], name: str = "items") -> DataFrame:
    """Rows of each key in an array, in order; for keys whose rows fit one row."""
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order_by, *rest))).alias(name))


def aggregate(df: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in columns.items()])


def some_of(test: Column) -> Column:
    """Aggregate: whether any row passes; null counts as false."""
    return F.coalesce(F.bool_or(F.coalesce(test, F.lit(False))), F.lit(False))


def every_of(test: Column) -> Column:
    return F.coalesce(F.bool_and(F.coalesce(test, F.lit(False))), F.lit(True))


def first_of(value: Column, order: Column) -> Column:
    return F.min_by(value, order)


def last_of(value: Column, order: Column) -> Column:
    return F.max_by(value, order)


def joined_text(value: Column, order: Column, separator: str = ",") -> Column:
    """Aggregate: texts in order, nulls as ''."""
    items = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.coalesce(value.cast("string"), F.lit("")).alias("t"))))
    return F.array_join(F.transform(items, lambda s: s["t"]), separator)


def pivot(df: DataFrame, keys: list[str], column: str, values: list, **columns: Column) -> DataFrame:
    """A column for each given value."""
    return df.groupBy(*keys).pivot(column, values).agg(*[c.alias(k) for k, c in columns.items()])


def row_number(keys: list[str], order_by: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)).cast("long")


def previous(value: Column, keys: list[str], order_by: list[Column], n: int = 1) -> Column:
    return F.lag(value, n).over(Window.partitionBy(*keys).orderBy(*order_by))


def following(value: Column, keys: list[str], order_by: list[Column], n: int = 1) -> Column:
    return F.lead(value, n).over(Window.partitionBy(*keys).orderBy(*order_by))


def running(total: Column, keys: list[str], order_by: list[Column]) -> Column:
    """An aggregate up to each row."""
    return total.over(Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0))


def moving(total: Column, keys: list[str], order_by: list[Column], n: int) -> Column:
    """An aggregate over each row and the n before it."""
    return total.over(Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(-n, 0))


def share(value: Column, keys: list[str]) -> Column:
    return value / F.sum(value).over(Window.partitionBy(*keys))


def top_k_of_each(df: DataFrame, keys: list[str], order_by: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each task's groups before the shuffle too."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).where(F.col("_rank") <= k).drop("_rank")


def fold_rows(df: DataFrame, keys: list[str], order_by: list[str], step: Callable, start: Callable[[], object], finish: Callable[[object], list[dict]], schema: str, most_rows: int = 1000) -> DataFrame:
    """An ordered fold of each key's rows by Python code: step(state, row) -> state, row as a dict of plain values, null
    as None and last in the order; finish gives the key's rows, without the keys. Spark sorts the rows, and a task reads
    them as a stream: only one key's state and one batch are in memory, however many rows a key has."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def same(a: tuple, b: tuple) -> bool:
        return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if key is None or not same(own, key):
                    if key is not None:
                        rows += [dict(zip(keys, key, strict=True)) | x for x in finish(state)]
                    key, state = own, start()
                    if len(rows) >= most_rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=out)
                        rows = []
                state = step(state, row)
        if key is not None:
            rows += [dict(zip(keys, key, strict=True)) | x for x in finish(state)]
        yield pa.RecordBatch.from_pylist(rows, schema=out)

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *[F.asc_nulls_last(c) for c in order_by])
    return ordered.mapInArrow(run, schema)


def fold(df: DataFrame, keys: list[str], order_by: list[str], step: Callable, start: Callable[[], object], finish: Callable[[object], dict], schema: str) -> DataFrame:
    """fold_rows with one row of each key: finish gives the columns beside the keys."""
    return fold_rows(df, keys, order_by, step, start, lambda state: [finish(state)], schema)
