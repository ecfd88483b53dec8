"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which alone separates words here.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a session of one machine
    gets a new one; on a cluster that is an error, since executors don't see the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/docframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes the files of written frames that nothing will read any more; what else was made from them is gone too."""
    for df in frames:
        path = getattr(df, "written_at", None)
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def bounded(df: DataFrame, rows: int, most_rows: int = 100_000) -> DataFrame:
    """df of narrow rows, sent to all tasks if there are no more than most_rows of them."""
    return F.broadcast(df) if rows <= most_rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The maximal runs of characters outside ASCII white space."""
    inner = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def smallest_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows with the smallest hashes of the key. On many rows a cut at twice their expected share comes
    first, so that not every task sends so many."""
    h, n = F.xxhash64(key), rows.count()
    if n > 4 * most:
        rows = rows.where(h < F.lit(int(-(1 << 63) + (2 * most / n) * (1 << 64))))
    return rows.orderBy(h, key).limit(most)


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of n rows for what is run (not only planned) inside: bounds what a Python worker holds of long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)
