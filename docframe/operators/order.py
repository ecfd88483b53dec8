"""Row order: contiguous positions, slices and single rows of a dataset in a stated order."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = (1 << 33) - 1


def with_position(df: DataFrame, order_by: list[Column], name: str = "_pos") -> DataFrame:
    """df sorted, with each row's place from 0 in a total order.

    A range sort, then each partition's count; places are the counts before a partition plus the place in it. Nothing is
    gathered but one number for each partition, and there is no single-partition window. The sorted rows are kept while
    they are counted, so that both passes see the same partitions.
    """
    sorted_ = df.orderBy(*order_by).withColumn("_mono", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    part, local = F.shiftrightunsigned("_mono", 33), F.col("_mono").bitwiseAND(F.lit(_LOCAL))
    counts = sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for r in counts:
        offsets.append((int(r["part"]), before))
        before += r["n"]
    spark = df.sparkSession
    table = spark.createDataFrame(offsets or [(0, 0)], "part long, offset long")
    placed = sorted_.withColumn("part", part.cast("long")).join(F.broadcast(table), "part")
    return placed.select(*df.columns, (F.col("offset") + local).cast("long").alias(name))


#: Up to so many rows from either end are taken as a top-k; what is deeper by places.
NEAR = 10_000


def slice_rows(df: DataFrame, order_by: list[Column], start: int = 0, end: int | None = None) -> DataFrame:
    """Rows from start to before end of the order; negatives count from the end. A slice near the beginning is a top-k,
    any other a filter on places, so that no task has more than its part of the rows."""
    if start >= 0 and end is not None and 0 <= end <= NEAR:
        return df.orderBy(*order_by).limit(max(end, start)).offset(start) if end > start else df.limit(0)
    n = df.count()
    a = max(0, n + start) if start < 0 else min(start, n)
    z = n if end is None else max(0, n + end) if end < 0 else min(end, n)
    placed = with_position(df, order_by, "_slice_pos")
    return placed.where((F.col("_slice_pos") >= a) & (F.col("_slice_pos") < z)).orderBy("_slice_pos").drop("_slice_pos")


def row_at(df: DataFrame, order_by: list[Column], i: int, reversed_: list[Column] | None = None) -> DataFrame:
    """The row at a place, none if there is none; for a negative place near the end give the opposite order too."""
    if i < 0:
        if reversed_ is None:
            raise ValueError("a negative place needs the opposite order")
        return row_at(df, reversed_, -i - 1)
    return slice_rows(df, order_by, i, i + 1)


def top_k(df: DataFrame, order_by: list[Column], k: int) -> DataFrame:
    """The first k rows: each task keeps its k, and those are merged."""
    return df.orderBy(*order_by).limit(k)


def running_total(df: DataFrame, order_by: list[Column], value: str, name: str = "running") -> DataFrame:
    """The sum of value up to each row over the whole dataset, in two phases: sums within sorted partitions, and the sums
    of the partitions before, of which there is one number each."""
    from pyspark.sql import Window

    placed = df.orderBy(*order_by).withColumn("_mono", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_mono", 33).cast("long")).persist(StorageLevel.DISK_ONLY)
    total, offsets = 0, []
    for r in placed.groupBy("_part").agg(F.sum(value).alias("s")).orderBy("_part").collect():
        offsets.append((r["_part"], total))
        total += r["s"] or 0
    kind = dict(placed.agg(F.sum(value).alias("s")).dtypes)["s"]
    table = df.sparkSession.createDataFrame([(p, str(s)) for p, s in offsets] or [(0, "0")], "_part long, _off string").withColumn("_off", F.col("_off").cast(kind))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy("_mono").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_in", within).join(F.broadcast(table), "_part").select(*df.columns, (F.coalesce("_in", F.lit(0)) + F.col("_off")).alias(name))
