"""Chunked delivery of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.operators.order import with_position

THRESHOLD, CHUNK = 1000, 500


def chunks(df: DataFrame, order_by: list[Column], threshold: int = THRESHOLD, size: int = CHUNK) -> DataFrame:
    """df with _pos, chunk, chunk_index (where it starts), chunk_end, is_last and total_items; a result under the
    threshold is one chunk."""
    placed = with_position(df, order_by)
    total = placed.count()
    step = size if total >= threshold else max(1, total)
    chunk = F.floor(F.col("_pos") / step).cast("long")
    end = F.least(chunk * step + step, F.lit(total)).cast("long")
    return placed.withColumns({"chunk": chunk, "chunk_index": (chunk * step).cast("long"), "chunk_end": end, "is_last": end == total, "total_items": F.lit(total).cast("long")})


def write_chunks(df: DataFrame, order_by: list[Column], path: str, size: int = CHUNK, files: int | None = None) -> None:
    """JSON lines with the chunk as a column; a chunk's rows follow one another in one file, and a file has many chunks."""
    rows = chunks(df, order_by, size=size).drop("chunk_index", "chunk_end", "is_last", "total_items")
    dealt = rows.repartitionByRange("chunk") if files is None else rows.repartitionByRange(files, "chunk")
    dealt.sortWithinPartitions("_pos").write.json(path)
