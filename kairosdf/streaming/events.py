"""The event stream as Structured Streaming: replay in micro-batches and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encoding import IDMapping, with_indexes
from ..operators.graph import event_columns


def read_stream(spark: SparkSession, folder: str, schema: str, *, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_graph_events(transactions: DataFrame, mapping: IDMapping) -> DataFrame:
    """Events of a stream of transactions; rows with unknown ids are dropped, as a stream can't be checked beforehand."""
    return event_columns(with_indexes(transactions, mapping, "inner"), mapping.num_customers)


def replay(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Call each(batch, number) for all that is there, once per batch even after a restart, and stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(stream: DataFrame, *, column: str = "timestamp", key: str = "event_type", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events per key and tumbling window, final once the watermark has passed.

    Watermarks need a time with zone: a timestamp without one is read as the
    session's, which is to be UTC.
    """
    at = F.col(column).cast("timestamp")
    counted = stream.withColumn("__at", at).withWatermark("__at", late).groupBy(F.window("__at", width), key).agg(F.count("*").alias("n_events"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), key, "n_events")
