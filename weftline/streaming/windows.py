"""Windows over the event stream. A stream is drained with availableNow into Parquet in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; event time as a timestamp with zone, which watermarks need."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    glob = path if not spark.read.parquet(path).inputFiles()[0].rstrip("/").endswith("/events.parquet") else f"{sf_dir}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if glob == sf_dir else "*.parquet").parquet(glob)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, delay: str = "365 days") -> DataFrame:
    kept = events.withWatermark("ts", delay)
    return kept.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


def first_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "365 days") -> DataFrame:
    kept = events.withWatermark("ts", delay)
    return kept.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def drained(result: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a stream gives for the data there is: its last complete result (or all appended rows)."""
    spark = result.sparkSession
    out, checkpoint = shared_path(spark, "stream-out"), shared_path(spark, "stream-state")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)
