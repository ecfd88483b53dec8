"""Sources: strict JSON documents, aliases, record arrays in wrappers, and where rows come from."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIAS = re.compile(r"[a-zA-Z_$][a-zA-Z0-9_$]*")
WRAPPERS = ("rows", "items", "data")


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, lines: bool = False, comments: bool = False) -> DataFrame:
    """JSON documents (or JSON lines), strictly: text that is no JSON is an error, which names the file where a schema is
    given."""
    reader = spark.read.options(multiLine=not lines, mode="FAILFAST", allowSingleQuotes=False, allowNonNumericNumbers=False, allowComments=comments)
    return (reader.schema(schema) if schema else reader).json(path)


def read_dynamic(spark: SparkSession, path: str | list[str], lines: bool = True) -> DataFrame:
    """Raw texts and their values as variants (columns raw, value), which tell null from missing; of equal keys the last
    counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = spark.read.text(path, wholetext=not lines).withColumnRenamed("value", "raw")
    return text.withColumn("value", F.parse_json("raw"))


def records(df: DataFrame) -> DataFrame:
    """The rows of a wrapped array: where the only column is rows, items or data and an array of objects; else df itself."""
    if len(df.columns) == 1 and df.columns[0] in WRAPPERS:
        kind = df.schema[0].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return df.select(F.inline(df.columns[0]))
    return df


def with_provenance(df: DataFrame) -> DataFrame:
    """Rows of files with file_path, file_name and file_dir."""
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.regexp_replace(path, r"/[^/]*\z", "").alias("file_dir"))


def sample_text(df: DataFrame, order_by: list[Column], rows: int = 2, chars: int = 1000) -> DataFrame:
    """One row `sample`: the first rows as JSON, cut to so many characters."""
    first = df.orderBy(*order_by).limit(rows)
    return first.agg(F.substring(F.to_json(F.collect_list(F.struct(*df.columns)), {"ignoreNullFields": "false"}), 1, chars).alias("sample"))


class Sources:
    """Datasets bound to aliases; `data` is the primary one, else the first."""

    def __init__(self, **bound: DataFrame):
        self._bound: dict[str, DataFrame] = {}
        for alias, df in bound.items():
            self.add(alias, df)

    def add(self, alias: str, df: DataFrame) -> None:
        if not ALIAS.fullmatch(alias):
            raise ValueError(f"not an alias: {alias!r}")
        if alias in self._bound:
            raise ValueError(f"alias is taken: {alias}")
        self._bound[alias] = df
        df.createOrReplaceTempView(f"`{alias}`")

    def rebind(self, alias: str, df: DataFrame) -> None:
        self._bound.pop(alias, None)
        self.add(alias, df)

    def remove(self, alias: str) -> None:
        df = self._bound.pop(alias)
        df.sparkSession.catalog.dropTempView(alias)

    def __getitem__(self, alias: str) -> DataFrame:
        return self._bound[alias]

    def __iter__(self):
        return iter(self._bound)

    def items(self):
        return self._bound.items()

    @property
    def primary(self) -> DataFrame:
        if not self._bound:
            raise ValueError("no source is bound")
        return self._bound["data" if "data" in self._bound else next(iter(self._bound))]
