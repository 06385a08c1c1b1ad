"""Incremental runs: row-local features of arriving documents, and windowed counters of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmill.functions import text as T


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents from parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def row_features(documents: DataFrame) -> DataFrame:
    """Diagnostics and gate of each document; no state is kept."""
    return T.diagnostics(documents).withColumn("reasons", T.gate_reasons())


def write_stream(features: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append features to parquet; a restarted run goes on after the documents it has processed."""
    return features.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and their value by type in tumbling or sliding windows; later ones than ``late`` are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events by user in sessions that a gap ends."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
