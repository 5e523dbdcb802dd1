"""Queries of verdicts and small measures that were not compared with SQL before: statuses, levels, what is heard, how it is said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import text as tx
from ..functions import validators as va
from ..operators import corpus, logs, stats
from .affect import _Z, _z
from .base import registry, table

QUERIES, SQL, query = registry()


def _listed(words: tuple[str, ...]) -> str:
    return "(" + ", ".join("'{}'".format(w.replace("'", "''")) for w in words) + ")"


@query("""SELECT count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS worst FROM events
WHERE value IS NOT NULL AND coalesce(CASE WHEN event_id % 5 <> 0 THEN event_type END, 'error') = 'error' AND coalesce(CASE WHEN event_id % 3 <> 0 THEN 'p' || user_id % 2 END, 'p1') = 'p1'""")
def latency_of_tier(spark: SparkSession, sf: str) -> DataFrame:
    """Latencies of one tier and profile; turns that do not say are counted in."""
    turns = table(spark, sf, "events").filter("value is not null").selectExpr("if(event_id % 5 <> 0, event_type, null) as tier", "if(event_id % 3 <> 0, concat('p', user_id % 2), null) as profile", "value as latency_ms")
    return stats.latency(logs.of_tier(turns, "error", "p1")).select("n", "p50", "p95", "worst")


_LEVELS = "list_transform(range(len(embedding) // 8), lambda i: sqrt(list_sum(list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda v: CAST(v AS DOUBLE) * v)) / 8))"


@query(f"SELECT vec_id, round(len(list_filter(l, lambda v: v < list_max(l) * pow(10, -6.0::DOUBLE / 20))) / len(l), 6) AS pauses, round(list_max(l), 5) AS loudest FROM (SELECT vec_id, {_LEVELS} AS l FROM embeddings) WHERE len(l) > 0")
def pause_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of frames of eight values more than 6 dB below the loudest."""
    levels = table(spark, sf, "embeddings").select("vec_id", ar.rms(F.col("embedding"), 8).alias("l")).filter(F.size("l") > 0)
    return levels.select("vec_id", F.round(ar.pause_ratio(F.col("l"), -6.0), 6).alias("pauses"), F.round(F.array_max("l"), 5).alias("loudest"))


_SAID = "CASE turn % 3 WHEN 0 THEN ' ' || coalesce(text, '') || ' ' WHEN 1 THEN list_value('Thank you.', ' Okay!', 'uh', 'you?', 'go on')[1 + conv_id % 5] ELSE coalesce(text, '') END"


@query(f"""SELECT conv_id, turn, sha256(CASE WHEN (conv_id % 7) / 10.0::DOUBLE > 0.4 OR -(conv_id % 3) * 0.6::DOUBLE < -1 OR lower(regexp_replace(said, '^[.,!? ]+|[.,!? ]+$', '', 'g')) IN {_listed(va.MADE_UP)} THEN '' ELSE trim(said) END) AS heard_sha256
FROM (SELECT conv_id, turn, {_SAID} AS said FROM conversations)""")
def heard_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of a recognised text whose worst segment may be unsure."""
    phrase = F.element_at(F.array(*map(F.lit, ("Thank you.", " Okay!", "uh", "you?", "go on"))), (1 + F.col("conv_id") % 5).cast("int"))
    text = F.coalesce("text", F.lit(""))
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), text, F.lit(" "))).when(F.col("turn") % 3 == 1, phrase).otherwise(text)
    got = va.heard(said, (F.col("conv_id") % 7) / 10.0, -(F.col("conv_id") % 3) * 0.6)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(got, 256).alias("heard_sha256"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN 'already' WHEN access IN ('request-form', 'paid', 'unavailable') THEN 'needs-' || access WHEN doc_id % 4 = 0 THEN 'no-data' WHEN n_chars * 100000.0 < 1.0 * 1e9 * 0.25 THEN 'too-small' ELSE 'done' END AS status
FROM (SELECT *, list_value('direct', 'paid', 'direct', 'request-form', 'direct')[1 + doc_id % 5] AS access FROM documents)) GROUP BY status""")
def fetch_statuses(spark: SparkSession, sf: str) -> DataFrame:
    access = F.element_at(F.array(*map(F.lit, ("direct", "paid", "direct", "request-form", "direct"))), (1 + F.col("doc_id") % 5).cast("int"))
    status = va.fetch_status(F.col("doc_id") % 4, F.col("n_chars") * 100_000.0, F.lit(1.0), F.col("doc_id") % 11 == 0, access)
    return table(spark, sf, "documents").select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT source AS name, CASE WHEN k % 7 = 6 THEN 'unreadable' WHEN k % 4 = 1 OR w <> 'yes' THEN 'refused' WHEN n < 2 THEN 'missing' ELSE 'included' END AS status
FROM (SELECT *, CASE k % 3 WHEN 2 THEN 'unclear' ELSE 'yes' END AS w FROM (SELECT source, count(*) AS n, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS k FROM documents WHERE source IS NOT NULL GROUP BY source))""")
def licence_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """The sources of documents as a manifest: closed by a flag, unclear, without enough rows, or not readable."""
    rows = table(spark, sf, "documents").filter("source is not null").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    k = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    manifest = rows.select("name", "n", F.when(k % 4 == 1, F.array(F.lit("NC"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.when(k % 3 == 2, "unclear").otherwise("yes").alias("weights_publishable"))
    readable = [r["name"] for r in rows.filter(k % 7 != 6).select("name").collect()]
    return corpus.licence_status(manifest, readable, F.col("n") >= 2, publishable_only=True).select("name", "status")


@query("""SELECT doc_id, regexp_matches(path, '(?i)^(data|recordings|evals)/.*\\.(wav|flac|mp3|ogg)$') AS tracked FROM (SELECT doc_id, list_value('data', 'Recordings', 'evals', 'src', 'x/data')[1 + doc_id % 5] || '/' || coalesce(source, '') || '/' || n_chars || list_value('.wav', '.FLAC', '.json', '.mp3')[1 + doc_id % 4] AS path FROM documents)""")
def recordings_tracked(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (1 + F.col("doc_id") % len(values)).cast("int"))
    path = F.concat_ws("/", pick(("data", "Recordings", "evals", "src", "x/data")), F.coalesce("source", F.lit("")), F.concat(F.col("n_chars").cast("string"), pick((".wav", ".FLAC", ".json", ".mp3"))))
    return table(spark, sf, "documents").select("doc_id", va.tracked_recording(path).alias("tracked"))


@query(f"""SELECT event_id, CASE WHEN event_id % 10 / 10.0::DOUBLE >= 0.45 THEN CASE WHEN z >= 2 THEN 'more energy than usual' WHEN z <= -2 THEN 'flatter and quieter than usual' END || ', tone-confidence ' || CASE WHEN event_id % 10 / 10.0::DOUBLE >= 0.7 THEN 'high' ELSE 'medium' END END AS words FROM {_Z} WHERE z IS NOT NULL""")
def described_readings(spark: SparkSession, sf: str) -> DataFrame:
    return _z(spark, sf).filter("z is not null").select("event_id", ar.describe(F.col("z"), (F.col("event_id") % 10) / 10.0).alias("words"))


@query("""SELECT conv_id, turn, sha256(CASE WHEN turn % 4 = 0 THEN coalesce(text, '') ELSE '[voice: ' || 'tone ' || conv_id % 3 || '] ' || coalesce(text, '') END) AS message_sha256 FROM conversations""")
def annotated_messages(spark: SparkSession, sf: str) -> DataFrame:
    note = F.when(F.col("turn") % 4 != 0, F.concat(F.lit("tone "), (F.col("conv_id") % 3).cast("string")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(tx.annotated(F.coalesce("text", F.lit("")), note), 256).alias("message_sha256"))


@query("""SELECT page_id, url_decode(replace(replace(url, ':', '%3A'), '/', '%2F')) AS name, lower(regexp_replace(url, '^[.,!? ]+|[.,!? ]+$', '', 'g')) IN ('thank you', 'https://site0.example/') AS is_blocked FROM pages""")
def url_names(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", tx.url_name(F.replace(F.replace(url, F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F"))).alias("name"), tx.blocked(url, ("thank you", "https://site0.example/")).alias("is_blocked"))
