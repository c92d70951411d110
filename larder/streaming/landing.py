"""Structured Streaming on the landing folder: pages become rows as they land, and offers are counted by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def page_stream(spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """One row for each product of every page that lands below the folder, once."""
    pages = spark.readStream.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).json(folder)
    return pages.select(F.explode("_embedded.products").alias("p")).select("p.*")


def windowed_counts(events: DataFrame, *, time: str = "ts", keys: tuple[str, ...] = ("event_type",), width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of values in tumbling windows; events later than `late` are dropped, so state is bounded."""
    timed = events.withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a folder, each input exactly once; ends when all that is there has been read."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
