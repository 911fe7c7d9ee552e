"""Windowed counts over the event stream: an addition, as nothing of the kind is in the inventory.

The same transformation serves a bounded table and a stream; on a stream the watermark bounds state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts(events: DataFrame, width: str = "10 minutes", late: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` per tumbling window."""
    source = events.withWatermark("ts", late) if late else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")
    )


def start(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, width: str = "10 minutes", late: str = "1 hour"):
    """Run the counts over files as they arrive until all present ones are read; restarting resumes from the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(path)
    return counts(stream, width, late).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
