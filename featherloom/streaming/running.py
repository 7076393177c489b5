"""Running profiles of a stream of rows.

The chunk-by-chunk accumulators of a batch audit are ordinary partial
aggregates; over a stream, Structured Streaming keeps them as state. All
outputs are whole ('complete' mode): a row per feature or category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.profile import moments, value_audit


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_moments(stream: DataFrame, columns: Sequence[str]) -> DataFrame:
    return moments(stream, columns)


def running_audit(stream: DataFrame, columns: Sequence[str]) -> DataFrame:
    return value_audit(stream, columns)


def running_categories(stream: DataFrame, column: str) -> DataFrame:
    return stream.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt"))


def windowed_counts(stream: DataFrame, time: str, group: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by group and tumbling window; rows later than ``late`` are dropped and closed windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("window"), F.col(group).alias("value")).agg(F.count("*").alias("cnt"))


def start_into(df: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs over what has arrived and stops; each result replaces the Parquet
    table at ``path``, written by the executors, however many rows it has."""
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs over what has arrived, into a table in the driver's memory, and
    stops: for results of a few rows, such as a row per feature."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
