"""Micro-batch ingestion with the rules of batch inserts, and windowed metrics of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphlake.operators.mutate import log_entry


def append_log(stream: DataFrame, target: str, checkpoint: str, entry: str, key: str, order: str) -> StreamingQuery:
    """Append every micro-batch to the change log at ``target``, one folder a batch, so that a batch that is run again replaces itself.

    Rows without a key are left out; of several rows of a key in a batch all stay, and replay takes the latest by ``order``.
    """

    def write(batch: DataFrame, number: int) -> None:
        good = batch.where(F.col(key).isNotNull())
        log_entry(good, entry, order, key).write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and keys, with a watermark; works on streams and tables. Timestamps without a zone are taken as session time."""
    t = stream.withColumn("_t", F.col(time).cast("timestamp"))
    if t.isStreaming:
        t = t.withWatermark("_t", late)
    out = t.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n")


def alive(heartbeats: DataFrame, now: F.Column, seconds: int = 5) -> DataFrame:
    """Processes ``(id, last_heartbeat)`` that have been heard of within ``seconds``."""
    return heartbeats.groupBy("id").agg(F.max("last_heartbeat").alias("last_heartbeat")).where(F.unix_timestamp(now) - F.unix_timestamp("last_heartbeat") < seconds)


def batch_stats(spark: SparkSession, target: str) -> DataFrame:
    """One row: batches, rows and mean rows a batch of a change log."""
    per = spark.read.parquet(target).groupBy("batch").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_rows"))
