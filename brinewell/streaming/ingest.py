"""Streaming ingestion of raw post files and incremental screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brinewell.operators.screening import ScreeningConfig, label
from brinewell.sources.normalize import normalize
from brinewell.sources.schemas import RAW_POST


def stream_posts(spark: SparkSession, path: str, provider: str, late: str = "8 days") -> DataFrame:
    """Typed posts from JSON-lines files as they arrive, each (id, instant) once within the watermark."""
    posts = normalize(spark.readStream.schema(RAW_POST).json(path), provider)
    return posts.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])


def label_stream(posts: DataFrame, path: str, checkpoint: str, config: ScreeningConfig = ScreeningConfig()) -> StreamingQuery:
    """Label what has arrived, append it by day, and stop; a restart goes on where the last commit ended."""
    labelled = label(posts, config).withColumn("day", F.to_date("created_at"))
    return labelled.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_counts(posts: DataFrame, late: str = "8 days") -> DataFrame:
    """Posts by community and day of a stream, for monitoring."""
    return posts.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "subreddit").count()
