"""Exact dedup by content sort, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.common import partitions, text_of


def exact_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
    splitter_chars: int = 48,
) -> DataFrame:
    """Group documents of equal normalised text; returns a frame with the struct `row` (every column of docs as it came),
    `keep_id`, `group_size`, `kept` and `text_sha256`.

    Sampled splitters deal the rows out by ranges of (leading characters, content hash); within a range an external sort
    by the full normalised text puts equal texts next to each other, and the window over the sorted run compares
    neighbours in full. A content hash counted over all rows finds texts that hold more than half a partition's share of
    the rows; their rows are spread over several ranges by the id, and the first rows of those ranges' runs are sorted
    and compared once more, which gives the text's size and smallest (or largest) id. There are fewer than two such texts
    for each partition, and each has one row of fixed width in the tables that are broadcast.

    Defined results: null text counts as empty; rows of null id are kept only when the group has no other id; of rows
    with the same id and text one stays; empty input gives no rows; other columns, whatever their names, pass through.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    body = text_of(text_col)
    body = body if normalise is None else normalise(body)
    # without a normaliser the text is carried once, as the sort key
    rest = [c for c in docs.columns if normalise is not None or c != text_col]
    src = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest], F.col(text_col).isNull().alias("_null_text")).alias("rest"),
        F.col(id_col).alias("id"),
        body.alias("body"),
    ).withColumn("h", F.xxhash64("body"))
    share = max(2, docs.count() // (2 * partitions(docs.sparkSession)))
    hot = (
        src.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
        .select("h", F.ceil(F.col("n") / share).cast("long").alias("parts"))
    )
    order = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()

    def compared(rows: DataFrame, *carried: str) -> DataFrame:
        """rows sorted within their ranges, each with its place in the run of equal texts there, the run's first id and size."""
        dealt = (
            rows.join(F.broadcast(hot), "h", "left")
            .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0).cast("long")))
            .withColumn("lead", F.substring("body", 1, splitter_chars))
            .drop("parts")
            .repartitionByRange("lead", "h", "salt")
        )
        run = Window.partitionBy("lead", "h", "salt", "body").orderBy(order)
        whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return dealt.select(
            *carried, "id", "body", F.row_number().over(run).alias("place"), F.first("id").over(whole).alias("keep_here"),
            F.count(F.lit(1)).over(whole).alias("size_here"), F.sha2("body", 256).alias("text_sha256"),
        )

    # the runs of a hot text's ranges are sorted once more by their first rows, and those compared with their neighbours
    heads = compared(src.join(F.broadcast(hot), "h", "left_semi").select("id", "body", "h")).where("place = 1")
    again = Window.partitionBy("body").orderBy(order)
    merged = heads.select(
        "text_sha256", F.row_number().over(again).alias("place"), F.first("id").over(again).alias("m_keep"),
        F.sum("size_here").over(again.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m_size"),
    ).where("place = 1").drop("place")
    keep_id = F.coalesce("m_keep", "keep_here")
    own = F.when(F.col("rest._null_text"), F.lit(None)).otherwise(F.col("body")).cast(docs.schema[text_col].dataType)
    row = [F.col(f"rest.`{c}`").alias(c) if c in rest else own.alias(c) for c in docs.columns]
    return compared(src, "rest").join(F.broadcast(merged), "text_sha256", "left").select(
        F.struct(*row).alias("row"),
        keep_id.alias("keep_id"),
        F.coalesce("m_size", "size_here").cast("long").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with their columns unchanged."""
    return exact_groups(docs, **options).where("kept").select("row.*")
