"""An extension beyond batch: engine performance as a stream, with late and redelivered records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.schema import PERFORMANCE


def performance_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records as they arrive in parquet files of a folder."""
    return spark.readStream.schema(PERFORMANCE).parquet(folder)


def daily_stats(records: DataFrame, lateness: str = "3 days") -> DataFrame:
    """Uses and mean accuracy by day and engine; records redelivered within the lateness count once, later ones are late."""
    fresh = records.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["id"])
    g = fresh.groupBy(F.window("created_at", "1 day").alias("w"), "engine_name").agg(F.count("*").alias("uses"), F.avg("accuracy_score").alias("mean_accuracy"))
    return g.select(F.col("w.start").alias("day"), "engine_name", "uses", "mean_accuracy")
