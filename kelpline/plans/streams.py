"""Streams over a table's file, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.sources import stage
from kelpline.streaming import scans, signals


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """Keys of an ordered scan's state: about 10,000 rows each, as users are many and have few rows, and a call for each costs more than its rows."""
    return max(512, -(-spark.read.parquet(f"{sf_dir}/events.parquet").count() // 10_000))


def scratch(spark: SparkSession) -> str:
    return stage.folder(spark, "stream")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def scanned(spark: SparkSession, sf_dir: str, fold, inputs: list[str]) -> DataFrame:
    """What an ordered scan of the events by user has given at the stream's end; sessions end two days after their last row."""
    at = scratch(spark)
    with scans.state_store(spark):
        out = scans.scan(events_stream(spark, sf_dir), fold, "user_id", "ts", "event_id", inputs, gap="2 days", late="1 hour", buckets=buckets(spark, sf_dir))
        return signals.run_to_end(out, f"{at}/out", f"{at}/state")


def finished_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, at = events_stream(spark, sf_dir), scratch(spark)
    out = signals.run_to_end(signals.tumbling(events, "ts", "event_type", "value"), f"{at}/out", f"{at}/state")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
