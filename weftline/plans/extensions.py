"""Queries over the event stream in windows, read as a stream and drained once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import windows
from .base import registry

QUERIES, SQL, query = registry()


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = windows.drained(windows.hourly(windows.events_stream(spark, sf)))
    return counted.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 2).alias("total"))


@query("SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return windows.drained(windows.first_seen(windows.events_stream(spark, sf)))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    got = windows.drained(windows.sessions(windows.events_stream(spark, sf)))
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
