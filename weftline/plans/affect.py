"""Queries of rolling baselines, bands and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as ar
from ..operators import assemble, folds, ranged, rolling
from .base import registry, table

QUERIES, SQL, query = registry()

_W = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"
_Z = f"""(SELECT event_id, user_id, ts, value, CASE WHEN sigma > 0 THEN greatest(-6.0, least(6.0, (value - centre) / sigma)) END AS z FROM (SELECT *, greatest(1.4826 * list_median(list_transform(past, lambda p: abs(p - centre))), 0.05 * abs(centre)) AS sigma
FROM (SELECT *, list_median(past) AS centre FROM (SELECT *, list(value) OVER {_W} AS past FROM events WHERE value IS NOT NULL))))"""


def _z(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").filter("value is not null").select("user_id", "ts", "event_id", "value")
    return rolling.rolling_z(rows, ["user_id"], ["ts", "event_id"], "value")


@query(f"SELECT event_id, round(z, 6) AS z FROM {_Z}")
def rolling_robust_z(spark: SparkSession, sf: str) -> DataFrame:
    return _z(spark, sf).select("event_id", F.round("z", 6).alias("z"))


@query(f"SELECT event_id, CASE WHEN z >= 1 THEN 'higher' WHEN z <= -1 THEN 'lower' ELSE 'usual' END AS band FROM {_Z} WHERE z IS NOT NULL")
def affect_bands(spark: SparkSession, sf: str) -> DataFrame:
    return _z(spark, sf).filter("z is not null").select("event_id", ar.band(F.col("z"), 1.0).alias("band"))


_DRIFT = """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE value IS NOT NULL), fold AS (
SELECT user_id, 0::BIGINT AS r, NULL::BIGINT AS event_id, NULL::DOUBLE AS z, false AS reset, []::DOUBLE[] AS past, 0 AS run FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, r, event_id, z, run2 >= 3, (list_append(CASE WHEN run2 >= 3 THEN []::DOUBLE[] ELSE past END, value))[-50:], CASE WHEN run2 >= 3 THEN 0 ELSE run2 END FROM (
SELECT *, CASE WHEN len(past) < 5 THEN run WHEN abs(z) >= 1 THEN run + 1 ELSE 0 END AS run2 FROM (SELECT *, CASE WHEN sigma > 0 THEN greatest(-6.0::DOUBLE, least(6.0::DOUBLE, (value - centre) / sigma)) END AS z FROM (
SELECT *, greatest(1.4826::DOUBLE * list_median(list_transform(past, lambda p: abs(p - centre))), 0.05::DOUBLE * abs(centre)) AS sigma FROM (
SELECT e.user_id, e.r, e.event_id, e.value, past, run, list_median(past) AS centre FROM fold JOIN e ON e.user_id = fold.user_id AND e.r = fold.r + 1)))))
SELECT event_id, round(z, 6) AS z, reset FROM fold WHERE r > 0"""


@query(_DRIFT)
def drift_resets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").filter("value is not null")
    got = folds.ordered_fold(rows, ["user_id"], ["ts", "event_id"], ["value"], lambda: folds.DriftingBaseline(extreme=1.0, runs=3), "z double, reset boolean", ["event_id"])
    return got.select("event_id", F.round("z", 6).alias("z"), "reset")


_HYSTERESIS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, CASE WHEN z >= 1 THEN 'higher' WHEN z <= -1 THEN 'lower' WHEN z IS NOT NULL THEN 'usual' END AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM {_Z}), fold AS (
SELECT user_id, 0::BIGINT AS r, NULL::BIGINT AS event_id, NULL::VARCHAR AS candidate, 'usual' AS band, []::VARCHAR[] AS recent FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, r, event_id, c, CASE WHEN c IS NOT NULL AND (len(now) < 2 OR len(list_filter(now, lambda x: x = c)) >= 2) THEN c ELSE band END, now FROM (
SELECT e.user_id, e.r, e.event_id, e.c, band, CASE WHEN e.c IS NULL THEN recent ELSE (list_append(recent, e.c))[-3:] END AS now FROM fold JOIN e ON e.user_id = fold.user_id AND e.r = fold.r + 1))
SELECT event_id, candidate, band, coalesce(candidate = band, true) AS settled FROM fold WHERE r > 0"""


@query(_HYSTERESIS)
def band_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    return ranged.fold(_z(spark, sf), ["user_id"], ["ts", "event_id"], ["z"], ranged.band_hysteresis(1.0), "candidate string, band string, settled boolean", ["event_id"]).drop("user_id")


def _moved(w: str, goal: str) -> str:
    v = f"({w} + ({goal} - {w}) * CASE WHEN {goal} > {w} THEN 1 - exp(-0.1::DOUBLE / 0.12::DOUBLE) ELSE 1 - exp(-0.1::DOUBLE / 0.30::DOUBLE) END)"
    return f"CASE WHEN {v} >= 0.01 THEN {v} ELSE 0 END"


#: Angry and relaxed are never asked for in this query and stay 0.
_BLEND = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, event_id % 4 AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), fold AS (
SELECT user_id, 0::BIGINT AS r, NULL::BIGINT AS event_id, 0::DOUBLE AS h, 0::DOUBLE AS s, 0::DOUBLE AS u, 0::DOUBLE AS age FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, r, event_id, h / greatest(1, h + s + u), s / greatest(1, h + s + u), u / greatest(1, h + s + u), age FROM (
SELECT user_id, r, event_id, age, {_moved("h", "gh")} AS h, {_moved("s", "gs")} AS s, {_moved("u", "gu")} AS u FROM (
SELECT *, CASE WHEN k = 0 THEN 0.8::DOUBLE ELSE 0 END AS gh, CASE WHEN k = 1 THEN 0.8::DOUBLE ELSE 0 END AS gs, CASE WHEN k <> 2 THEN 0 WHEN age > 0.9 THEN 0.8::DOUBLE * exp((0.9::DOUBLE - age) / 0.6::DOUBLE) ELSE 0.8::DOUBLE END AS gu FROM (
SELECT e.user_id, e.r, e.event_id, e.k, h, s, u, CASE WHEN e.k = 2 THEN age + 0.1::DOUBLE ELSE 0 END AS age FROM fold JOIN e ON e.user_id = fold.user_id AND e.r = fold.r + 1))))
SELECT event_id, round(h + s + u, 6) AS total, round(u, 6) AS surprised FROM fold WHERE r > 0"""


@query(_BLEND)
def expression_blend(spark: SparkSession, sf: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("happy", "sad", "surprised", "neutral"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", label.alias("label"), F.lit(0.8).alias("intensity"), F.lit(0.1).alias("dt"))
    got = folds.ordered_fold(rows, ["user_id"], ["ts", "event_id"], ["label", "intensity", "dt"], lambda: folds.Blender(), "weights map<string,double>", ["event_id"])
    return got.select("event_id", F.round(F.aggregate(F.map_values("weights"), F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.round(F.col("weights")["surprised"], 6).alias("surprised"))


#: Two lanes for each event: one from its value, one from its number; either may be silent or unsure.
_LANES = """(SELECT event_id, CASE WHEN event_id % 5 <> 3 THEN value / 10.0 - 3 END AS a1, CASE WHEN event_id % 5 <> 3 THEN (event_id % 7) / 7.0 END AS v1, CASE WHEN event_id % 5 <> 3 THEN (event_id % 4) / 4.0 END AS c1, 5 + event_id % 9 AS n1,
CASE WHEN event_id % 6 <> 4 THEN (event_id % 13) / 2.0 - 3 END AS a2, CASE WHEN event_id % 6 <> 4 THEN (event_id % 3) / 3.0 END AS v2, CASE WHEN event_id % 6 <> 4 THEN (event_id % 3) / 2.0 END AS c2, 3 + event_id % 11 AS n2 FROM events WHERE value IS NOT NULL)"""


@query(f"""WITH w AS (SELECT *, coalesce(c1, 0) * 0.6::DOUBLE AS w1, coalesce(c2, 0) * 0.4::DOUBLE AS w2, CASE WHEN abs(a1) < 2 THEN 0 ELSE sign(a1) END AS s1, CASE WHEN abs(a2) < 2 THEN 0 ELSE sign(a2) END AS s2 FROM {_LANES})
SELECT event_id, round(CASE WHEN w1 > 0 AND w2 > 0 THEN (a1 * w1 + a2 * w2) / (w1 + w2) WHEN w1 > 0 THEN a1 WHEN w2 > 0 THEN a2 END, 6) AS arousal,
round(CASE WHEN w1 > 0 AND w2 > 0 THEN (v1 * w1 + v2 * w2) / (w1 + w2) WHEN w1 > 0 THEN v1 WHEN w2 > 0 THEN v2 END, 6) AS valence,
round(CASE WHEN w1 > 0 AND w2 > 0 THEN greatest(0, least(1, (w1 + w2) * CASE WHEN s1 = 0 OR s2 = 0 THEN 1.0::DOUBLE WHEN s1 = s2 THEN 1.25::DOUBLE ELSE 0.4::DOUBLE END)) WHEN w1 > 0 THEN c1 WHEN w2 > 0 THEN c2 END, 6) AS confidence,
CASE WHEN w1 > 0 AND w2 > 0 THEN least(n1, n2) WHEN w1 > 0 THEN n1 WHEN w2 > 0 THEN n2 END AS baseline_n FROM w""")
def lane_fusion(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    lane = lambda silent, a, v, c, n, name: F.when(~silent, F.struct(a.alias("arousal_z"), v.alias("valence_z"), c.alias("confidence"), F.array(F.lit(name)).alias("events"), n.alias("baseline_n")))
    one = lane(e % 5 == 3, F.col("value") / 10.0 - 3, (e % 7) / 7.0, (e % 4) / 4.0, 5 + e % 9, "x")
    two = lane(e % 6 == 4, (e % 13) / 2.0 - 3, (e % 3) / 3.0, (e % 3) / 2.0, 3 + e % 11, "y")
    f = table(spark, sf, "events").filter("value is not null").select("event_id", one.alias("a"), two.alias("b")).select("event_id", ar.fuse(F.col("a"), F.col("b")).alias("f"))
    return f.select("event_id", *[F.round(f"f.{c}", 6).alias(n) for c, n in (("arousal_z", "arousal"), ("valence_z", "valence"), ("confidence", "confidence"))], F.col("f.baseline_n").alias("baseline_n"))


@query("""SELECT vec_id, CAST(n AS INT) AS n, round(s, 3) AS total FROM (SELECT vec_id, count(*) OVER w AS n, sum(e) OVER w AS s FROM (SELECT vec_id, label, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS e FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4""")
def sliding_vectors(spark: SparkSession, sf: str) -> DataFrame:
    ahead = Window.partitionBy("label").orderBy("vec_id").rowsBetween(0, 3)
    rows = table(spark, sf, "embeddings").withColumn("window", F.collect_list("embedding").over(ahead)).filter(F.size("window") == 4)
    total = F.aggregate(F.flatten("window"), F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", F.size("window").alias("n"), F.round(total, 3).alias("total"))


@query("""SELECT vec_id, CAST(n AS INT) AS n, round(s, 3) AS total FROM (SELECT vec_id, count(*) OVER w AS n, sum(e) OVER w AS s FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS e FROM embeddings) WINDOW w AS (ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4""")
def sliding_vectors_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors as one sequence, in blocks that reach into each other."""
    rows = assemble.windows_ahead(table(spark, sf, "embeddings"), [], ["vec_id"], "embedding", 4, 100)
    total = F.aggregate(F.flatten("window"), F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", F.size("window").alias("n"), F.round(total, 3).alias("total"))


@query("""SELECT vec_id, CAST(10 AS INT) AS cut, CAST(200 AS INT) AS grown, round(list_sum(list_transform(embedding[CAST(floor((len(embedding) - 10) / 2) AS INT) + 1 : CAST(floor((len(embedding) - 10) / 2) AS INT) + 10], lambda v: CAST(v AS DOUBLE))), 4) AS total FROM embeddings""")
def fit_clip(spark: SparkSession, sf: str) -> DataFrame:
    cut, grown = ar.fit_clip(F.col("embedding"), 10), ar.fit_clip(F.col("embedding"), 200)
    total = F.aggregate(cut, F.lit(0.0), lambda s, v: s + v)
    return table(spark, sf, "embeddings").select("vec_id", F.size(cut).alias("cut"), F.size(grown).alias("grown"), F.round(total, 4).alias("total"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v)) / len(embedding)), 5) AS rms, round(list_max(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)))), 5) AS peak FROM embeddings""")
def gain_check(spark: SparkSession, sf: str) -> DataFrame:
    g = ar.gain(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(g["rms"], 5).alias("rms"), F.round(g["peak"], 5).alias("peak"))
