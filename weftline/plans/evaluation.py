"""Queries of evaluation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..operators import ranks, stats
from .base import registry, table

QUERIES, SQL, query = registry()

def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang, reference, hypothesis): the words of items against those of the documents of the same number."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("reference"))
    pairs = table(spark, sf, "documents").select("doc_id", "lang", "text").join(items, "doc_id")
    return pairs.select("doc_id", "lang", tx.spoken_words(F.col("reference")).alias("reference"), tx.spoken_words(F.col("text")).alias("hypothesis"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("doc_id", "lang", F.size("reference").alias("ref_words"), tx.word_errors(F.col("reference"), F.col("hypothesis")).alias("errors"))


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(nfc_normalize({t})), '\p{{Cf}}', '', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}'']', ' ', 'g'), ' +'), lambda w: w <> '')"
#: The table of distances, one reference word at a time: a running minimum stands for the insertions.
_LEV = f"""(WITH RECURSIVE p AS MATERIALIZED (SELECT d.doc_id, d.lang, {_WORDS.format(t='b.text')} AS r, {_WORDS.format(t='d.text')} AS h FROM documents d JOIN benchmark b ON d.doc_id = b.item_id),
h AS MATERIALIZED (SELECT doc_id, j, CASE WHEN j > 0 THEN h[j] END AS w FROM p, unnest(range(0, len(h) + 1)) AS u(j)),
dp AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, j, j AS d FROM h
UNION ALL SELECT doc_id, i, j, j + min(c - j) OVER (PARTITION BY doc_id ORDER BY j) FROM (
SELECT dp.doc_id, dp.i + 1 AS i, dp.j, coalesce(least(dp.d + 1, lag(dp.d) OVER (PARTITION BY dp.doc_id ORDER BY dp.j) + CASE WHEN h.w = p.r[dp.i + 1] THEN 0 ELSE 1 END), dp.d + 1) AS c
FROM dp JOIN p ON p.doc_id = dp.doc_id AND dp.i < len(p.r) JOIN h ON h.doc_id = dp.doc_id AND h.j = dp.j))
SELECT p.doc_id, p.lang, len(p.r) AS ref_words, dp.d AS errors FROM p JOIN dp ON p.doc_id = dp.doc_id AND dp.i = len(p.r) AND dp.j = len(p.h))"""


@query(f"SELECT doc_id, CAST(ref_words AS INT) AS ref_words, CAST(errors AS INT) AS errors FROM {_LEV}")
def wer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("doc_id", "ref_words", "errors")


@query(f"SELECT coalesce(lang, '(unlabelled)') AS lang, count(*) AS n, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(ref_words) AS BIGINT) AS words, round(sum(errors) / sum(ref_words), 6) AS wer FROM {_LEV} GROUP BY 1")
def wer_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf).withColumn("lang", F.coalesce("lang", F.lit("(unlabelled)")))
    return stats.corpus_wer(rows, ["lang"]).withColumn("wer", F.round("wer", 6))


@query(f"SELECT doc_id, round(errors / greatest(1, ref_words), 6) AS rate FROM {_LEV} ORDER BY 2 DESC, 1 LIMIT 5")
def wer_worst5(spark: SparkSession, sf: str) -> DataFrame:
    return stats.worst(_scored(spark, sf), "doc_id").select("doc_id", F.round("rate", 6).alias("rate"))


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)


def _auc_sql(by: str | None) -> str:
    part, cols = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"""(SELECT {cols}count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, coalesce((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 'NaN'::DOUBLE) AS auc
FROM (SELECT {cols}y, rank() OVER ({part} ORDER BY n_chars) + (count(*) OVER (PARTITION BY {cols}n_chars) - 1) / 2.0 AS r FROM (SELECT d.source, d.lang, d.n_chars, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS y FROM documents d JOIN labels USING (doc_id))) {'GROUP BY ' + by if by else ''})"""


@query(f"SELECT n, n_pos, round(auc, 9) AS auc FROM {_auc_sql(None)}")
def auc_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return stats.auc(_rated(spark, sf), "n_chars", "good").withColumn("auc", F.round("auc", 9))


@query(f"SELECT source, n, n_pos, round(auc, 9) AS auc FROM {_auc_sql('source')} WHERE n >= 6 AND NOT isnan(auc)")
def auc_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return stats.auc(_rated(spark, sf), "n_chars", "good", ["source"], stats.AUC_LEAST).filter(~F.isnan("auc")).withColumn("auc", F.round("auc", 9))


@query(f"SELECT count(*) AS groups, round(avg(auc), 9) AS mean, round(median(auc), 9) AS median, round(min(auc), 9) AS least, round(max(auc), 9) AS largest, avg(auc) > 0.8 AS passed FROM {_auc_sql('source')} WHERE n >= 6 AND NOT isnan(auc)")
def auc_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.auc_summary(_rated(spark, sf), "n_chars", "good", "source").withColumns({c: F.round(c, 9) for c in ("mean", "median", "least", "largest")})


_CCC = "round(2 * covar_pop(l_quantity, l_extendedprice / 2000) / (var_pop(l_quantity) + var_pop(l_extendedprice / 2000) + pow(avg(l_quantity) - avg(l_extendedprice / 2000), 2)), 6)"


@query(f"SELECT count(*) AS n, {_CCC} AS ccc FROM lineitem")
def ccc_global(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 2000).alias("p")).agg(F.count("*").alias("n"), F.round(stats.concordance("l_quantity", "p"), 6).alias("ccc"))


@query(f"SELECT l_returnflag, count(*) AS n, {_CCC} AS ccc, round(stddev_pop(l_quantity), 6) AS spread FROM lineitem GROUP BY 1")
def ccc_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 2000).alias("p"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(stats.concordance("l_quantity", "p"), 6).alias("ccc"), F.round(F.stddev_pop("l_quantity"), 6).alias("spread"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 1.0) AS p100 FROM events GROUP BY 1")
def pct_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.nearest_ranks(table(spark, sf, "events"), ["event_type"], "value", {f"p{round(q * 100)}": q for q in (0.5, 0.9, 0.95, 1.0)}).drop("n")


@query("SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS worst FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.latency(table(spark, sf, "events"), ["event_type"], "value")


#: Turns as replies that begin with a tag of some kind, or with none; their texts are whole.
_REPLY = """CASE (conv_id * 7 + turn) % 9 WHEN 0 THEN '<e:happy:' || turn % 10 || '> ' || text WHEN 1 THEN '<e:sad:' || conv_id % 10 || '>' || text WHEN 2 THEN text WHEN 3 THEN '<e:joyful:3> ' || text
WHEN 4 THEN '<e:angry:5> ' || text || ' <e:sad:1> yes' WHEN 5 THEN '  <e:neutral:0> ' || text WHEN 6 THEN '<E:happy:1> ' || text WHEN 7 THEN '< e : happy : 3 > ' || text ELSE text || ' <e:happy:3>' END"""
_REPLIES_SQL = f"(SELECT conv_id, turn, {_REPLY} AS reply FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations))"
_VERDICT = f"""(SELECT conv_id AS id, CASE WHEN NOT regexp_matches(t, '{tx.TAG}') THEN CASE WHEN len(regexp_extract_all(t, '(?i)<\\s*e\\s*:[^>]*>')) > 0 THEN 'malformed' ELSE 'missing' END
WHEN len(regexp_extract_all(t, '(?i)<\\s*e\\s*:[^>]*>')) > 1 THEN 'misplaced' ELSE 'ok' END AS verdict, CASE WHEN regexp_matches(t, '{tx.TAG}') THEN regexp_extract(t, '{tx.TAG}', 1) END AS label FROM (SELECT conv_id, ltrim(reply) AS t FROM {_REPLIES_SQL}))"""


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, turn and the turn as a reply with a tag."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).select("conv_id", "turn", F.expr(_REPLY).alias("reply"))


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return replies(spark, sf).select("conv_id", tx.tag_verdict(F.col("reply")).alias("v")).select("conv_id", "v.verdict", "v.label")


@query(f"SELECT v AS verdict, count(id) AS n FROM (SELECT unnest(['ok', 'missing', 'malformed', 'misplaced']) AS v) LEFT JOIN {_VERDICT} ON v = verdict GROUP BY v")
def compliance_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.filled(_verdicts(spark, sf).groupBy("verdict").agg(F.count("*").alias("n")), "verdict", stats.TAG_VERDICTS, ["n"])


@query(f"SELECT count(*) AS n, round(avg(CASE WHEN verdict = 'ok' THEN 1.0 ELSE 0 END), 4) AS rate, avg(CASE WHEN verdict = 'ok' THEN 1.0 ELSE 0 END) >= 0.98 AS passed, (SELECT max(c) / sum(c) > 0.8 FROM (SELECT count(*) AS c FROM {_VERDICT} WHERE label IS NOT NULL GROUP BY label)) AS flat FROM {_VERDICT}")
def compliance_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.compliance(_verdicts(spark, sf))


@query(f"SELECT l AS label FROM (SELECT unnest(['happy', 'angry', 'sad', 'relaxed', 'surprised', 'neutral']) AS l) WHERE l NOT IN (SELECT label FROM {_VERDICT} WHERE label IS NOT NULL)")
def unused_labels(spark: SparkSession, sf: str) -> DataFrame:
    used = _verdicts(spark, sf).agg(F.collect_set("label").alias("used"))
    return used.select(F.explode(F.array_except(F.array(*map(F.lit, tx.TAG_LABELS)), "used")).alias("label"))


@query("""SELECT count(*) AS n, quantile_disc(CASE WHEN value >= 20 AND event_type = 'error' THEN value END, 0.5) AS p50, quantile_disc(CASE WHEN value >= 20 AND event_type = 'error' THEN value END, 0.9) AS p90,
round(avg(CASE WHEN event_type <> 'error' THEN CASE WHEN value >= 20 THEN 1.0 ELSE 0 END END), 6) AS false_cuts, round(avg(CASE WHEN event_type = 'error' THEN CASE WHEN value >= 20 THEN 0.0 ELSE 1 END END), 6) AS missed FROM events WHERE value IS NOT NULL""")
def endpoint_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").filter("value is not null").select((F.col("value") >= 20).alias("fired"), (F.col("event_type") == "error").alias("ended"), "value")
    return stats.endpoint(rows, "fired", "ended", "value").select("n", "p50", "p90", F.round("false_cuts", 6).alias("false_cuts"), F.round("missed", 6).alias("missed"))


@query("""SELECT t AS threshold, round(count(*) FILTER (quality = 1 AND n_chars >= t) / count(*) FILTER (quality = 1), 6) AS recall, round(count(*) FILTER (quality <> 1 AND n_chars >= t) / (count(*) FILTER (quality <> 1) * 0.08 / 3600), 4) AS false_accepts_per_hour
FROM (SELECT unnest([500.0::DOUBLE, 1000.0, 2000.0, 4000.0]) AS t), (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)) GROUP BY t""")
def fa_per_hour_sweep(spark: SparkSession, sf: str) -> DataFrame:
    got = stats.sweep(_rated(spark, sf), "n_chars", "good", [500, 1000, 2000, 4000], 0.08)
    return got.select("threshold", F.round("recall", 6).alias("recall"), F.round("false_accepts_per_hour", 4).alias("false_accepts_per_hour"))


@query("SELECT event_type, round(exp(least(sum(value) / sum(10 + event_id % 7), 20)), 6) AS perplexity FROM events WHERE value IS NOT NULL GROUP BY 1")
def perplexity_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").filter("value is not null").select("event_type", "value", (10 + F.col("event_id") % 7).alias("tokens"))
    return rows.groupBy("event_type").agg(F.round(stats.perplexity("value", "tokens"), 6).alias("perplexity"))


#: Names of labels and of nothing in every spelling, one for each document.
_NAMES = [*lb.ALIASES, *lb.CIRCUMPLEX, "no such", "xxx"]
_RAW = f"list_value({', '.join(f"'{n}'" for n in _NAMES)})[1 + doc_id % {len(_NAMES)}]"
_NAMES_SQL = f"(SELECT DISTINCT CASE n_chars % 3 WHEN 0 THEN upper(raw) WHEN 1 THEN ' ' || replace(raw, '_', '-') || ' ' ELSE raw END AS raw FROM (SELECT n_chars, {_RAW} AS raw FROM documents)) AS v"
_ALIAS_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in lb.ALIASES.items()) + ") AS a(k, v)"
_PLACE_SQL = "(VALUES " + ", ".join(f"('{k}', {v}, {a})" for k, (v, a) in lb.CIRCUMPLEX.items()) + ") AS c(name, valence, arousal)"


@query(f"""SELECT raw, coalesce(c.name, '') AS label, CAST(valence AS DOUBLE) AS valence, CAST(arousal AS DOUBLE) AS arousal FROM (SELECT raw, coalesce(a.v, key) AS name FROM (SELECT raw, translate(lower(trim(raw)), ' -', '__') AS key FROM {_NAMES_SQL})
LEFT JOIN {_ALIAS_SQL} ON key = a.k) x LEFT JOIN {_PLACE_SQL} ON x.name = c.name""")
def label_map_circumplex(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (1 + F.col("doc_id") % len(_NAMES)).cast("int"))
    spelt = F.when(F.col("n_chars") % 3 == 0, F.upper(name)).when(F.col("n_chars") % 3 == 1, F.concat(F.lit(" "), F.replace(name, F.lit("_"), F.lit("-")), F.lit(" "))).otherwise(name)
    raw = table(spark, sf, "documents").select(spelt.alias("raw")).distinct()
    place = lb.circumplex(F.col("raw"))
    return raw.select("raw", lb.canonical(F.col("raw")).alias("label"), place["valence"].alias("valence"), place["arousal"].alias("arousal"))


#: Up to three indices of fine labels for each document, some out of range.
_INDEX = "[doc_id % 29, n_chars % 28, doc_id % 28]"
_FINE_SQL = "(VALUES " + ", ".join(f"({i}, '{n}', {chr(39) + lb.FINE_TAGS[n] + chr(39) if n in lb.FINE_TAGS else 'NULL'})" for i, n in enumerate(lb.FINE_NAMES)) + ") AS f(i, name, tag)"


@query(f"""WITH d AS (SELECT doc_id, {_INDEX}[1 : doc_id % 4] AS labels FROM documents), e AS (SELECT doc_id, unnest(labels) AS i FROM d)
SELECT d.doc_id, CASE WHEN len(labels) = 0 THEN 'neutral' WHEN unknown = 0 AND tags = 1 THEN tag END AS tag FROM d LEFT JOIN
(SELECT doc_id, count(*) FILTER (name IS NULL OR (tag IS NULL AND name NOT IN ({', '.join(f"'{n}'" for n in lb.FINE_IGNORED)}))) AS unknown, count(DISTINCT tag) AS tags, min(tag) AS tag FROM e LEFT JOIN {_FINE_SQL} ON e.i = f.i GROUP BY doc_id) g ON d.doc_id = g.doc_id""")
def tag_label(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.expr("slice(array(doc_id % 29, n_chars % 28, doc_id % 28), 1, cast(doc_id % 4 as int))")
    return table(spark, sf, "documents").select("doc_id", lb.one_tag(lb.names_of(ids.cast("array<int>")), lb.FINE_TAGS, lb.FINE_IGNORED).alias("tag"))
