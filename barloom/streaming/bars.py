"""Bars from a stream of ticks: event-time windows closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder, with ``arrived``, the time their file was written."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def windowed_bars(
    ticks: DataFrame, every: str = "1 hour", late: str = "2 hours", time: str = "ts", key: str = "event_type", value: str = "value"
) -> DataFrame:
    """(ticker, ts, close, high, low, volume) per key and window of positive values; the same sums as batch bars.

    A window is given out once, when the latest time seen is ``late`` past its end; rows for windows
    already given out are dropped.  Only sums per open window are kept as state.  Values
    are summed in cents, so the order of arrival does not change a bar.
    """
    cents = F.round(F.col(value) * 100).cast("long")
    bars = (
        ticks.withColumn(time, F.col(time).cast("timestamp"))
        .filter(F.col(value) > 0)
        .withWatermark(time, late)
        .groupBy(F.window(time, every).alias("w"), F.col(key).alias("ticker"))
        .agg(
            (F.sum(cents) / F.count(F.lit(1)) / 100).alias("close"),
            (F.max(cents) / F.lit(100.0)).alias("high"),
            (F.min(cents) / F.lit(100.0)).alias("low"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )
    return bars.select("ticker", F.col("w.start").alias("ts"), "close", "high", "low", "volume")


def write_available(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Append what has arrived since the last run to a Parquet table; returns how much came too late.

    The checkpoint knows which files were read and which windows are open, and the table's log which
    files belong to it: a run that was killed is taken up without loss or repeats.  Late rows
    are counted after the map-side sum: one per window, key and task.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
