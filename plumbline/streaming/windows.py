"""EXT: windowed metrics over a stream of scored events (Z-05) and an incremental score log (Z-03).

The same aggregation serves batch and streaming; the reference of this engine's rules has
no event time, so this is an extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import clip


def event_scores(events: DataFrame, *more: str) -> DataFrame:
    """event_id, at, label, score and further columns; null values have no score and are left out."""
    rows = events.where(F.col("value").isNotNull())
    return rows.select(
        "event_id", F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"), clip(F.col("value") / 100).alias("score"), *more
    )


def windowed(scores: DataFrame, size: str, slide: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Tumbling or sliding windows; partial aggregates only, so a hot window costs one row per task."""
    yes = F.col("score") >= threshold
    return scores.groupBy(F.window("at", size, slide) if slide else F.window("at", size)).agg(
        F.count(F.lit(1)).alias("count"), F.count_if((F.col("label") == 1) & yes).alias("tp"), F.count_if((F.col("label") == 0) & yes).alias("fp"),
        F.avg("score").alias("mean_score"),
    )


def hourly(scores: DataFrame) -> DataFrame:
    out = windowed(scores, "1 hour")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:00:00").alias("hour"), "count", "tp", "fp", "mean_score")


def stream_metrics(spark: SparkSession, folder: str, schema, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A streaming frame over Parquet files: repeats of an event inside the watermark count once."""
    events = spark.readStream.schema(schema).parquet(folder)
    scores = event_scores(events).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    return windowed(scores, size)


def append_scores(spark: SparkSession, folder: str, schema, out: str, checkpoint: str):
    """Z-03: scores what is new and appends it; the checkpoint remembers finished files, so a restart resumes."""
    scores = event_scores(spark.readStream.schema(schema).parquet(folder))
    query = scores.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query
