"""Statistics over a stream of events; an addition of this library, with watermarks and checkpoints of Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stats(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON as they are appended."""
    return spark.readStream.schema(schema).json(path)


def tier_counts(stats: DataFrame, time: str = "retrieved_at", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """How many videos each tier served by window; rows later than ``late`` are dropped by the watermark."""
    return stats.withWatermark(time, late).groupBy(F.window(time, width), "transcript_source").agg(F.count("*").alias("videos"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def first_of_each(stats: DataFrame, key: str, time: str = "retrieved_at", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark, so that a rerun adds nothing."""
    return stats.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
