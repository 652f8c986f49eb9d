"""Event logs as streams: the latest event of each fact, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENTS


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_events(events: DataFrame) -> DataFrame:
    """fact_id with its newest event; run in update mode. One small state row a fact."""
    return events.groupBy("fact_id").agg(F.max_by(F.struct("id", "event_type", "actor", "at"), "id").alias("e")).select("fact_id", "e.*")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; windows close once the watermark passes them."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))
