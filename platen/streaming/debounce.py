"""Streaming forms: sessions of edits with late data, and debounced saves, on Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled


def edit_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Streaming or batch: one row per user and session (a run of events less than ``gap`` apart)."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a finite stream to its end and gives what it wrote, through a Parquet sink in the shared folder."""
    settled(spark.range(0))  # makes sure that a shared folder is set
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
