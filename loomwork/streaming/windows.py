"""Event-time windows and incremental refresh, for batch and for Structured Streaming alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window, event_type, n, total) of events (ts, event_type, value); streams drop what is later than ``late``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def refresh_stream(changes: DataFrame, target: str, checkpoint: str, key: str = "path") -> StreamingQuery:
    """Keeps the latest row of each key of a change stream (key, seq, ...) in a Parquet table.

    Each batch is merged with the last version and written as a version of its own, named by the batch; a batch that runs
    again after a failure writes the same version.
    """
    spark = changes.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        w = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
        rows = batch
        if epoch:
            rows = spark.read.schema(batch.schema).parquet(f"{target}/v={epoch - 1}").unionByName(batch)
        rows.withColumn("_n", w).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{target}/v={epoch}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
