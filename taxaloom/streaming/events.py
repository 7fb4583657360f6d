"""Stage events as a stream: JSON lines, counted by window with late events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "ts timestamp, stage string, event string, study_id string, n bigint, latency_ms double"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Events as they are written to a folder; lines that do not parse are left out."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(folder).where("ts is not null")


def stage_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and studies by window, stage and kind; the state of windows older than the watermark is dropped.

    Works on a stream and on a table alike.
    """
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    seen = marked.groupBy(F.window("ts", window).alias("w"), "stage", "event").agg(F.count("*").alias("n"), F.approx_count_distinct("study_id").alias("studies"), F.avg("latency_ms").alias("mean_latency_ms"))
    return seen.select(F.col("w.start").alias("start"), "stage", "event", "n", "studies", "mean_latency_ms")


def write_counts(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows to Parquet; what is there already is taken and the query ends."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def too_soon(events: DataFrame, by: str, least_seconds: float, tie: str) -> DataFrame:
    """The events with `too_soon`: whether less time than the limiter's interval has gone by since the caller's one before."""
    at = F.unix_micros("ts") / 1e6
    gap = at - F.lag(at).over(Window.partitionBy(by).orderBy("ts", tie))
    return events.withColumn("too_soon", F.coalesce(gap < least_seconds, F.lit(False)))
