"""Progressive delivery: a folder of JSON lines read as a stream, shown as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Progress:
    """Rows received of a total, and rounded percent, after each batch."""

    def __init__(self, total: int):
        self.total, self.received, self.steps = total, 0, []

    def add(self, n: int) -> None:
        self.received += n
        self.steps.append((self.received, round(100 * self.received / self.total) if self.total else 100))


def deliver(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, total: int, files_at_once: int = 1) -> Progress:
    """Appends what is in source to the Parquet folder sink, batch by batch; what a checkpoint has seen isn't sent again."""
    progress = Progress(total)

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        progress.add(batch.count())
        batch.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return progress
