"""The run history as a stream: each run's file is one addition to a file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.settings import located, settings
from stepwell.sources.history import SCHEMA


def events_stream(spark: SparkSession) -> DataFrame:
    """Events as they are written, with event_time for watermarks."""
    path = located(f"{settings.events_dir}/events-*/")
    return spark.readStream.schema(SCHEMA).json(path).where("id is not null").withColumn("event_time", F.to_timestamp("ts"))


def activity(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each type per window; windows close when the watermark passes them."""
    return stream.withWatermark("event_time", late).groupBy(F.window("event_time", window), "type").agg(F.count("*").alias("n"))
