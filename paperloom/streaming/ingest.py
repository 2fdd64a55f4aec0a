"""New papers as they arrive. Documents are independent, so a stream needs no state and no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def paper_stream(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, text of files as they appear in a folder."""
    rows = spark.readStream.format("text").option("wholetext", True).load(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def extracted(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies a batch extraction to every micro-batch and appends it to Parquet; a repeated batch overwrites its own folder,
    so each paper is in the output once."""

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
