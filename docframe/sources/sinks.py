"""Sinks: results as JSON and CSV files."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions import values
from docframe.operators import present


def output_name(stem: str, suffix: str, now: datetime) -> str:
    """stem, the ISO time with - for : and ., and the suffix."""
    time = now.isoformat(timespec="milliseconds").replace(":", "-").replace(".", "-")
    return f"{stem}-{time}Z.{suffix}"


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in a folder, nulls written."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_pretty(df: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """One file with a pretty array, for small results: more than most_rows is an error."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows: write_json writes them in parts")
    row = values.to_json_text(F.struct(*[F.col(f"`{c}`") for c in df.columns]), T.StructType(df.schema.fields))
    lines = df.coalesce(1).select(row.alias("t"), F.monotonically_increasing_id().alias("o"))
    whole = lines.agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda s: s["t"]).alias("all"))
    whole.select(values.pretty_json(F.concat(F.lit("["), F.array_join("all", ","), F.lit("]"))).alias("value")).coalesce(1).write.text(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header in each file, in the form of present.csv_lines."""
    write_lines(present.csv_lines(df), present.csv_header(df), path, one_file)


def write_dynamic_csv(df: DataFrame, text: str, keys: list[str], path: str, one_file: bool = False) -> None:
    """The same for JSON texts by key (present.header gives the union of all keys)."""
    write_lines(present.dynamic_csv_lines(df, text, keys), ",".join(keys), path, one_file)


def write_primitives_csv(df: DataFrame, column: str, path: str, one_file: bool = False) -> None:
    """The same for single values, under the header Value."""
    write_csv(df.select(F.col(f"`{column}`").alias("Value")), path, one_file)


def with_header(lines: DataFrame, header: str) -> DataFrame:
    """A header before the lines of each part that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([header], pa.string())], ["value"])
                first = False
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], ["value"])

    return lines.mapInArrow(run, "value string")


def write_lines(lines: DataFrame, header: str, path: str, one_file: bool) -> None:
    if lines.isEmpty():
        lines.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.text(path)
    else:
        with_header(lines.coalesce(1) if one_file else lines, header).write.text(path)
