"""Queries of state machines and of operators that assemble streams, against SQL on the events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import assemble, listen, ranged, stats
from .base import registry, table

QUERIES, SQL, query = registry()
_EVENTS = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE value IS NOT NULL)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("value is not null")


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, r, value >= 10 AS loud FROM {_EVENTS}), fold AS (
SELECT user_id, 0::BIGINT AS r, NULL::BIGINT AS event_id, NULL::BOOLEAN AS side, 0.0::DOUBLE AS run, false AS speaking, NULL::VARCHAR AS change FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, r, event_id, loud, run, CASE WHEN loud AND NOT speaking AND run >= 96 THEN true WHEN NOT loud AND speaking AND run >= 200 THEN false ELSE speaking END,
CASE WHEN loud AND NOT speaking AND run >= 96 THEN 'started' WHEN NOT loud AND speaking AND run >= 200 THEN 'stopped' END
FROM (SELECT e.user_id, e.r, e.event_id, e.loud, CASE WHEN e.loud IS NOT DISTINCT FROM fold.side THEN fold.run + 32 ELSE 32 END AS run, fold.speaking FROM fold JOIN e ON e.user_id = fold.user_id AND e.r = fold.r + 1))
SELECT event_id, change FROM fold WHERE r > 0""")
def speech_gate_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).withColumn("p", F.when(F.col("value") >= 10, 0.9).otherwise(0.1))
    return ranged.fold(rows, ["user_id"], ["ts", "event_id"], ["p"], ranged.speech_gate(), "change string", ["event_id"]).select("event_id", "change")


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, r, value >= 20 AS loud FROM {_EVENTS}), fold AS (
SELECT user_id, 0::BIGINT AS r, NULL::BIGINT AS event_id, 0.0::DOUBLE AS speech FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.r, e.event_id, CASE WHEN e.r * 32 >= 200 AND e.loud THEN fold.speech + 32 ELSE 0 END FROM fold JOIN e ON e.user_id = fold.user_id AND e.r = fold.r + 1)
SELECT event_id, speech >= 250 AS interrupts FROM fold WHERE r > 0""")
def barge_in(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).withColumn("p", F.when(F.col("value") >= 20, 0.9).otherwise(0.1))
    return ranged.fold(rows, ["user_id"], ["ts", "event_id"], ["p"], ranged.barge_in(), "interrupts boolean", ["event_id"]).select("event_id", "interrupts")


@query(f"""SELECT event_id, CAST(sum(CASE WHEN event_type IS NOT DISTINCT FROM before AND r > 1 THEN 0 ELSE 1 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
FROM (SELECT event_id, ts, event_type, lag(event_type) OVER (ORDER BY ts, event_id) AS before, row_number() OVER (ORDER BY ts, event_id) AS r FROM events)""")
def runs_of_all_events(spark: SparkSession, sf: str) -> DataFrame:
    """All events as one sequence, over all tasks."""
    return ranged.fold(table(spark, sf, "events"), [], ["ts", "event_id"], ["event_type"], ranged.Changes(), "run long", ["event_id"]).select("event_id", "run")


@query("""SELECT label, n // 100 AS hop, round(sum(v), 4) AS total FROM (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS n FROM (SELECT label, vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)))
GROUP BY 1, 2 HAVING count(*) = 100""")
def hops_of_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as frames of one sequence a label, cut into hops of 100 values across their borders."""
    got = listen.hops(table(spark, sf, "embeddings"), ["label"], ["vec_id"], "embedding", 100)
    return got.select("label", "hop", F.round(F.aggregate("values", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query()
def turn_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames: loud where the value is high, the end probable after an error, playback with every purchase."""
    frames = table(spark, sf, "events").select(
        "user_id", "ts", "event_id", (F.coalesce("value", F.lit(0.0)) / 30).alias("p"), F.lit(0.2).alias("level"), F.when(F.col("event_type") == "error", 0.9).otherwise(0.1).alias("complete"), (F.col("event_type") == "purchase").alias("begins"),
    )
    return listen.turns(frames, ["user_id"], ["ts", "event_id"], listen.Limits(frame=1.0, pre_roll=1.0, start=1.0, stop=2.0, dead=1.0, hold=1.0, longest_wait=5.0, resume=4.0))


@query("SELECT doc_id, string_agg(CASE WHEN m <> 0 THEN i ELSE -100 END, ',' ORDER BY k) AS masked FROM (SELECT doc_id, k, (doc_id + k) % 97 AS i, k % 3 AS m FROM documents, range(7) AS r(k)) GROUP BY doc_id")
def masked_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids, mask = F.expr("transform(sequence(0, 6), k -> (doc_id + k) % 97)"), F.expr("transform(sequence(0, 6), k -> k % 3)")
    return table(spark, sf, "documents").select("doc_id", F.array_join(arrays.masked(ids, mask).cast("array<string>"), ",").alias("masked"))


@query("SELECT doc_id, string_agg(k, ',' ORDER BY k) AS tail FROM (SELECT doc_id, k, doc_id % 9 AS n FROM documents, range(9) AS r(k) WHERE k <= doc_id % 9) WHERE k > n - 4 GROUP BY doc_id")
def tail_of_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.expr("sequence(0, cast(doc_id % 9 as int))")
    return table(spark, sf, "documents").select("doc_id", F.array_join(arrays.tail(ids, 4).cast("array<string>"), ",").alias("tail"))


@query("""SELECT event_id, CASE WHEN event_id % 50 < 5 THEN 0.0 ELSE greatest(0.0, least(1.0, round((0.4 + 0.6 * least(1.0, sqrt((event_id % 50) / 50.0))) * least(1.0, (event_id % 7) / 10.0 / 0.5) * least(1.0, (event_id % 4) / 3.0), 9))) END AS sure
FROM events""")
def reading_confidence(spark: SparkSession, sf: str) -> DataFrame:
    got = arrays.confidence(F.col("event_id") % 50, (F.col("event_id") % 7) / 10.0, (F.col("event_id") % 4).cast("double"))
    return table(spark, sf, "events").select("event_id", F.round(got, 9).alias("sure"))


@query("SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN value ELSE (value - 0.5 * (event_id % 5)) / 1.5 END, 9) AS reading FROM events WHERE value IS NOT NULL")
def composite_reading(spark: SparkSession, sf: str) -> DataFrame:
    z = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("a"), F.col("value"))).otherwise(F.create_map(F.lit("a"), F.col("value"), F.lit("b"), (F.col("event_id") % 5).cast("double")))
    return _events(spark, sf).select("event_id", F.round(arrays.composite(z, {"a": 1.0, "b": -0.5}), 9).alias("reading"))


@query("""SELECT round(avg(CASE WHEN doc_id % 4 < 3 THEN 1.0 ELSE 0.0 END), 9) AS well_formed, round(avg(CASE WHEN doc_id % 4 < 3 THEN CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 1.0 END END), 9) AS known,
coalesce((SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT DISTINCT '<tool_call>' || doc_id AS x FROM documents WHERE doc_id % 4 = 3 ORDER BY x LIMIT 3)), '') AS examples FROM documents""")
def tool_call_rates(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import calls

    block = "concat('<tool_call><function=', if(doc_id % 4 = 0, 'other', 'mine'), '><parameter=a>', doc_id, '</parameter></function></tool_call>')"
    replies = table(spark, sf, "documents").select(F.expr(f"if(doc_id % 4 = 3, concat('<tool_call>', doc_id), {block})").alias("reply"))
    got = stats.call_rates(replies.select("reply", calls.call_shape(F.col("reply"), F.array(F.lit("mine"))).alias("check")))
    return got.select(F.round("well_formed", 9).alias("well_formed"), F.round("known", 9).alias("known"), F.array_join("examples", ";").alias("examples"))


@query("SELECT doc_id, CASE WHEN doc_id % 700 - 3 < 0 THEN 'negative' WHEN doc_id % 700 - 3 >= (SELECT count(*) FROM pages) THEN 'beyond the end' END AS reason, url FROM documents LEFT JOIN (SELECT page_id, url FROM pages) ON page_id = doc_id % 700 - 3")
def places_in_a_list(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 700 - 3).alias("index"))
    return assemble.positions(table(spark, sf, "pages").select(F.col("page_id").alias("index"), "url"), asked).select("doc_id", "reason", "url")


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 12) AS nonce FROM documents")
def nonces(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.digest12(F.coalesce("text", F.lit(""))).alias("nonce"))
