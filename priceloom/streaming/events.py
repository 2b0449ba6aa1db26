"""Streams of price events with watermarks; each query also stands for its batch result."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark, which needs a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def per_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, high: counts and the largest value of each tumbling window."""
    rows = _timed(events, late)
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("high"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "high")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, stop, n of each session."""
    rows = _timed(events, late)
    grouped = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    return _timed(events, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_once(frame: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop; the checkpoint remembers it."""
    frame.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
