"""Streams: contracts' text to typed blocks as files arrive, and event-time windows that follow late rows.

Each job runs over what has arrived and ends (``availableNow``); started again with the same checkpoint
it goes on from there. A lost executor or driver repeats a batch, and no row of it counts twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ingest import block_type
from ..sources.contracts import document_blocks


def stream_blocks(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str) -> DataFrame:
    """Append the typed blocks of new Parquet files of documents to ``out`` and return all of it; the sink's log names each batch once."""
    arrived = document_blocks(spark.readStream.schema(schema).parquet(folder)).withColumn("block_type", block_type(F.col("text")))
    arrived.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def stream_windows(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, width: str, delay: str) -> DataFrame:
    """window_start, event_type, n_events, max_value of events in windows of ``width``; rows later than ``delay`` may go, as the watermark says.

    A batch writes the windows it changed below its own number, overwriting what an earlier attempt left; the last batch of a window holds."""
    events = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counted = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.max("value").alias("max_value"))
    changed = counted.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "max_value")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    latest = F.max_by(F.struct("n_events", "max_value"), "batch").alias("v")
    return spark.read.parquet(out).groupBy("window_start", "event_type").agg(latest).select("window_start", "event_type", "v.n_events", "v.max_value")
