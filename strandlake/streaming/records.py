"""File streams of records: batch operators applied to every micro-batch.

The workflows process complete files, so a stream is only a way to take files as they come: each
micro-batch runs the batch operators, and results are appended by batch number, which makes a repeated batch replace itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators.centroids import assign
from strandlake.sources.records import lengths


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(source, content) of files that appear in a folder."""
    return spark.readStream.option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def each_batch(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs step on every micro-batch and writes the result under its batch number; takes what is there and stops."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record_lengths(batch: DataFrame) -> DataFrame:
    from strandlake.sources.records import lines

    return lengths(lines(batch), "source")


def assignments(hits: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A step that assigns the sequences of a batch (orf_id) to centroids by a table of hits."""
    return lambda batch: assign(batch, hits)
