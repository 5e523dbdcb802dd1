"""Queries over event streams and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, logs, ranged, ranks
from .base import registry, table

QUERIES, SQL, query = registry()

#: Event types stand in for stages, in this order.
_STAGES = ("signup", "view", "click", "purchase", "error")


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """First second of each event type of a user and day."""
    rows = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id", "day", "event_type").agg(F.min("us").alias("us")).withColumn("turn", F.concat_ws(":", "user_id", "day"))


_DAYS = "(SELECT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS turn, event_type, min(epoch_us(ts)) AS us, list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) AS place FROM events GROUP BY user_id, CAST(ts AS DATE), event_type)"


@query(f"""SELECT step, count(*) AS n, quantile_disc(ms, 0.5) AS p50 FROM (SELECT event_type || '->' || lead(event_type) OVER w AS step, (lead(us) OVER w - us) / 1000.0 AS ms FROM {_DAYS} WINDOW w AS (PARTITION BY turn ORDER BY place)) WHERE ms IS NOT NULL GROUP BY step""")
def waterfall_stages(spark: SparkSession, sf: str) -> DataFrame:
    days = _days(spark, sf).withColumn("t", F.col("us") / 1e6)
    w = logs.stage_steps(days.withColumn("t", F.col("us")), "turn", "event_type", "t", _STAGES).withColumn("ms", F.col("ms") / 1e6)
    return ranks.nearest_ranks(w.select("step", "ms"), ["step"], "ms", {"p50": 0.5}).select("step", "n", "p50")


@query(f"SELECT turn, (max(CASE WHEN event_type = 'purchase' THEN us END) - max(CASE WHEN event_type = 'view' THEN us END)) / 1000.0 AS ms FROM {_DAYS} GROUP BY turn HAVING ms IS NOT NULL")
def headline_latency(spark: SparkSession, sf: str) -> DataFrame:
    lines = _days(spark, sf).groupBy("turn").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "us"))).alias("timeline"))
    return lines.select("turn", (logs.headline(F.col("timeline"), "view", "purchase") / 1e6).alias("ms")).filter("ms is not null")


@query("""SELECT event_id FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'purchase' AND o.user_id = e.user_id AND CAST(o.ts AS DATE) = CAST(e.ts AS DATE))""")
def audit_unfinished(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "click", "attempted").when(F.col("event_type") == "purchase", "succeeded").otherwise("other")
    rows = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), kinds.alias("event"))
    return logs.unfinished(rows, ["user_id", "day"]).select("event_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call FROM events")
def audit_call_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return logs.numbered_calls(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("event_id", F.col("call").cast("long").alias("call"))


@query("SELECT event_id, ['one', 'two', 'three'][1 + (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) % 3] AS line FROM events")
def error_line_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return logs.rotated(table(spark, sf, "events"), "event_type", ["ts", "event_id"], ("one", "two", "three")).select("event_id", "line")


_LOUD = "(SELECT *, value IS NOT NULL AND value >= 20 AS loud FROM events)"


@query(f"""SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN loud IS NOT DISTINCT FROM
lag(loud) OVER (PARTITION BY user_id ORDER BY ts, event_id) AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 0 ELSE 1 END AS chg FROM {_LOUD})) WHERE loud GROUP BY 1, 2 HAVING count(*) >= 3""")
def speech_gate_sessions(spark: SparkSession, sf: str) -> DataFrame:
    loud = table(spark, sf, "events").withColumn("loud", F.coalesce(F.col("value") >= 20, F.lit(False)))
    rows = ranged.fold(loud, ["user_id"], ["ts", "event_id"], ["loud"], ranged.Changes(), "run long", ["event_id", "loud"]).filter("loud")
    return rows.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).filter("n >= 3")


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return rows.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


_DAY = 86_400.0


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), fold AS (
SELECT user_id, 0::BIGINT AS r, NULL::BIGINT AS event_id, false AS admitted, []::DOUBLE[] AS past FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.r, e.event_id, len(list_filter(past, lambda p: e.at - p < 86400)) < 2,
CASE WHEN len(list_filter(past, lambda p: e.at - p < 86400)) < 2 THEN list_append(list_filter(past, lambda p: e.at - p < 86400), e.at) ELSE list_filter(past, lambda p: e.at - p < 86400) END FROM fold JOIN e ON e.user_id = fold.user_id AND e.r = fold.r + 1)
SELECT event_id, admitted FROM fold WHERE r > 0""")
def rate_limit_events(spark: SparkSession, sf: str) -> DataFrame:
    return folds.ordered_fold(_ordered(spark, sf), ["user_id"], ["ts", "event_id"], ["at"], lambda: folds.RateLimit(2, _DAY), "admitted boolean", ["event_id"]).select("event_id", "admitted")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), fold AS (
SELECT user_id, 0::BIGINT AS r, NULL::BIGINT AS event_id, false AS passes, NULL::DOUBLE AS last FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.r, e.event_id, last IS NULL OR e.at - last >= 86400, CASE WHEN last IS NULL OR e.at - last >= 86400 THEN e.at ELSE last END FROM fold JOIN e ON e.user_id = fold.user_id AND e.r = fold.r + 1)
SELECT event_id, passes FROM fold WHERE r > 0""")
def refractory_events(spark: SparkSession, sf: str) -> DataFrame:
    return ranged.fold(_ordered(spark, sf), ["user_id"], ["ts", "event_id"], ["at"], ranged.Gaps(_DAY), "passes boolean", ["event_id"]).select("event_id", "passes")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), fold AS (
SELECT user_id, 0::BIGINT AS r, NULL::BIGINT AS event_id, 0::BIGINT AS streak, false AS used FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.r, e.event_id, CASE WHEN ok THEN greatest(0, streak) + 1 ELSE least(0, streak) - 1 END, CASE WHEN ok THEN greatest(0, streak) + 1 >= 3 OR used ELSE false END FROM fold JOIN e ON e.user_id = fold.user_id AND e.r = fold.r + 1)
SELECT event_id, streak, used FROM fold WHERE r > 0""")
def tier_streaks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("ok", F.col("event_type") != "error")
    return ranged.fold(rows, ["user_id"], ["ts", "event_id"], ["ok"], ranged.Streaks(), "streak long, used boolean", ["event_id"]).select("event_id", "streak", "used")


@query("SELECT event_id, CASE WHEN json_type(props) = 'OBJECT' THEN CAST(len(json_keys(props)) AS BIGINT) END AS n_keys FROM events")
def json_object_args(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n")).select("event_id", F.when(F.col("n") >= 0, F.col("n")).alias("n_keys"))
