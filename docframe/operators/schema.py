"""Distributed schema inference over JSON values: types, unions and optional keys, at every depth."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: place: the steps of a path as a JSON array, so that a key with a dot differs from a nested one; parent: that of the
#: object that has the key, null for items and the whole.
SCHEMA = "place string, parent string, path string, type string, n long"
_TYPES = {str: "string", list: "array", dict: "object", bool: "boolean", int: "number", float: "number", type(None): "null"}


def _no_constant(name: str):
    raise ValueError(f"not JSON: {name}")


def _walk(whole, seen: Counter) -> None:
    """Counts every value's path and type, without recursion."""
    todo = [((), None, whole)]
    while todo:
        steps, parent, value = todo.pop()
        seen[steps, parent, _TYPES[type(value)]] += 1
        if isinstance(value, dict):
            todo += [((*steps, k), steps, v) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [((*steps, None), None, v) for v in value]


def _shown(steps: tuple) -> str:
    """a.b[].c"""
    return "".join("[]" if k is None else f".{k}" for k in steps).removeprefix(".")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if text is not None:
                _walk(json.loads(text, parse_constant=_no_constant), seen)
        rows = [(json.dumps(s), None if p is None else json.dumps(p), _shown(s), t, n) for (s, p, t), n in seen.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [pa.string()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["place", "parent", "path", "type", "n"])


def infer(df: DataFrame, text: str) -> DataFrame:
    """The schema of a column of JSON texts, over all rows: path (array items as []), types (sorted), n_present, n_null,
    optional (there are objects at the parent path without the key). Text that is no JSON, such as NaN, is an error.
    Each batch gives one row for a path and type, so what is shuffled grows with the paths."""
    counted = df.select(F.col(text)).mapInArrow(_counts, SCHEMA).groupBy("place", "parent", "path", "type").agg(F.sum("n").alias("n"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("n"))), F.lit(0)).cast("long")
    found = counted.groupBy("place", "parent", "path").agg(
        F.array_sort(F.collect_list("type")).alias("types"), F.sum("n").alias("n_present"), of("null").alias("n_null"), of("object").alias("n_objects")
    )
    owners = found.select(F.col("place").alias("_owner"), F.col("n_objects").alias("_n_owner"))
    joined = found.join(owners, F.col("parent") == F.col("_owner"), "left")
    return joined.select("path", "types", "n_present", "n_null", F.coalesce(F.col("n_present") < F.col("_n_owner"), F.lit(False)).alias("optional"))


def infer_sample(df: DataFrame, text: str, order_by: list[Column], n: int = 20) -> DataFrame:
    """The same over the first n rows of an order."""
    return infer(df.orderBy(*order_by).limit(n).select(text), text)


def infer_aliases(sources: dict[str, DataFrame], text: str) -> DataFrame:
    """One schema with a property for each alias."""
    out = None
    for alias, df in sources.items():
        own = infer(df, text)
        path = F.when(F.col("path") == "", alias).when(F.col("path").startswith("["), F.concat(F.lit(alias), F.col("path"))).otherwise(F.concat(F.lit(alias + "."), F.col("path")))
        own = own.withColumn("path", path)
        out = own if out is None else out.unionByName(own)
    return out


def union(types: Column) -> Column:
    """Distinct types, sorted, joined by a bar."""
    return F.array_join(F.array_sort(F.array_distinct(types)), " | ")


def item_type(types: Column) -> Column:
    """What an array's items are: any of none or of more than three types, else their union."""
    n = F.size(F.array_distinct(types))
    return F.when(types.isNull() | (n == 0) | (n > 3), "any").otherwise(union(types))


def effective(types: Column) -> Column:
    """The type to work with: null left out, one that is left, any of several."""
    rest = F.filter(F.array_distinct(types), lambda t: t != "null")
    return F.when(F.size(rest) == 1, F.get(rest, F.lit(0))).when(F.size(rest) == 0, "null").otherwise("any")


def listing(found: DataFrame) -> DataFrame:
    """One text for each path: name : type (optional)."""
    text = F.concat(F.col("path"), F.lit(" : "), F.array_join("types", " | "), F.when(F.col("optional"), " (optional)").otherwise(""))
    return found.where("path <> ''").select("path", text.alias("field"))
