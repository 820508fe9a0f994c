"""Refreshing the index from a stream of new files: an extension for roots that Spark's file source can watch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftlode.operators import chunking


def stream_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, text), one row for each new text file of ``folder``."""
    lines = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return lines.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def append_chunks(texts: DataFrame, embed: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Cut, embed and append every micro-batch; a batch that is run again replaces its own folder, so rows come once."""

    def write(batch: DataFrame, number: int) -> None:
        embed(chunking.chunk(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
