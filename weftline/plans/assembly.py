"""Queries of validators, assembled parts, rings and voice measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..functions import validators as va
from ..operators import assemble, stats
from .base import registry, table
from .corpora import _SPACE
from .evaluation import _REPLIES_SQL, replies

QUERIES, SQL, query = registry()


def _listed(words: tuple[str, ...]) -> str:
    return "(" + ", ".join("'{}'".format(w.replace("'", "''")) for w in words) + ")"


#: Every phrase of the lists, as it may be heard, and whole turns of conversations.
_PHRASES = (*va.YES, *va.NO, *va.MADE_UP, "yes but only if it is not too late", "perhaps", "")
_PHRASE = "list_value(" + ", ".join("'{}'".format(w.replace("'", "''")) for w in _PHRASES) + f")[1 + (conv_id * 5 + turn) % {len(_PHRASES)}]"
_SAID = f"(SELECT conv_id, turn, (conv_id % 7) / 10.0 AS no_speech, CASE turn % 4 WHEN 0 THEN upper({_PHRASE}) || '!' WHEN 1 THEN '  ' || {_PHRASE} || ' . ' WHEN 2 THEN replace({_PHRASE}, ' ', '   ') ELSE coalesce(text, '') END AS said FROM conversations)"
_PLAIN = r"trim(regexp_replace(regexp_replace(lower(said), '[^\p{L}\p{N}\s'']', '', 'g'), '\s+', ' ', 'g'))"


@query(f"""SELECT conv_id, turn, voice, coalesce(CASE turn % 5 WHEN 0 THEN 'no' END, voice, 'timeout') AS decision FROM (SELECT conv_id, turn, CASE WHEN p = '' OR p IN {_listed(va.MADE_UP)} OR no_speech > 0.4 OR len(string_split(p, ' ')) > 4 THEN 'ambiguous'
WHEN p IN {_listed(va.YES)} THEN 'yes' WHEN p IN {_listed(va.NO)} THEN 'no' ELSE 'ambiguous' END AS voice FROM (SELECT conv_id, turn, no_speech, {_PLAIN} AS p FROM {_SAID}))""")
def confirm_answers(spark: SparkSession, sf: str) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (1 + (F.col("conv_id") * 5 + F.col("turn")) % len(_PHRASES)).cast("int"))
    turn = F.col("turn") % 4
    said = F.when(turn == 0, F.concat(F.upper(phrase), F.lit("!"))).when(turn == 1, F.concat(F.lit("  "), phrase, F.lit(" . "))).when(turn == 2, F.replace(phrase, F.lit(" "), F.lit("   "))).otherwise(F.coalesce("text", F.lit("")))
    heard = table(spark, sf, "conversations").select("conv_id", "turn", va.answer(said, (F.col("conv_id") % 7) / 10.0, F.lit(-0.2)).alias("voice"))
    return heard.withColumn("decision", va.decision(F.col("voice"), F.when(F.col("turn") % 5 == 0, "no")))


#: Payloads that pass and that do not, made from the columns of documents, whole texts among them.
_PAYLOAD = r"""CASE doc_id % 10 WHEN 0 THEN concat('hl.dsp.focus({workspace = ', doc_id, '})') WHEN 1 THEN concat('hl.dsp.focus({title = "', source, '"})') WHEN 2 THEN concat('hl.dsp.move({x = ', n_chars, '})')
WHEN 3 THEN 'hl.dsp.focus({os.time()})' WHEN 4 THEN text WHEN 5 THEN '  ' WHEN 6 THEN concat(' hl.dsp.focus({a = true, b = "', lang, '"}) ') WHEN 7 THEN concat('hl.dsp.FOCUS({a = ', doc_id, '})') WHEN 8 THEN concat('hl.dsp.focus({title = "', text, '"})') ELSE concat('require(', doc_id, ')') END"""
_SHAPE = r"""(?i)^hl\.dsp\.([a-z_.]+)\(\{\s*(?:[a-z_]+\s*=\s*(?:\d+|true|false|"[A-Za-z0-9:_\-. ]*")\s*,?\s*)*\}\)$"""


@query(f"""SELECT doc_id, CASE WHEN coalesce(trim(payload), '') = '' THEN 'empty' WHEN len(list_filter([{', '.join(f"'{w}'" for w in va.FORBIDDEN)}], lambda w: contains(lower(payload), w))) > 0 THEN 'forbidden'
WHEN NOT regexp_matches(trim(payload), '{_SHAPE}') THEN 'shape' WHEN regexp_extract(trim(payload), '{_SHAPE}', 1) NOT IN ('focus') THEN 'dispatcher' END AS reason FROM (SELECT doc_id, {_PAYLOAD} AS payload FROM documents)""")
def payload_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr(_PAYLOAD).alias("payload")).select("doc_id", va.egress_reason(F.col("payload")).alias("reason"))


@query("""SELECT pair, count(DISTINCT lower(trim(text))) = 2 AS differ FROM (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant') WHERE r = 1)
GROUP BY pair HAVING count(*) = 2""")
def matched_replies(spark: SparkSession, sf: str) -> DataFrame:
    """The first answers of conversations 2n and 2n + 1."""
    answers = table(spark, sf, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return assemble.matched_pairs(answers.withColumn("pair", F.floor(F.col("conv_id") / 2)), "pair", "conv_id", F.col("text"))


_HEAD, _NUMBER, _MARK = "^([A-Z][a-z]+)", "([0-9]{2,})", "([!?;])"


@query(f"""WITH lines AS (SELECT doc_id, i AS pos, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
b AS (SELECT *, sum(CAST(regexp_matches(line, '{_HEAD}') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM lines),
f AS (SELECT doc_id, block, max(CASE WHEN regexp_matches(line, '{_HEAD}') THEN regexp_extract(line, '{_HEAD}', 1) END) AS head, max(CASE WHEN regexp_matches(line, '{_NUMBER}') THEN regexp_extract(line, '{_NUMBER}', 1) END) AS number,
max(CASE WHEN regexp_matches(line, '{_MARK}') THEN regexp_extract(line, '{_MARK}', 1) END) AS mark FROM b WHERE block > 0 GROUP BY doc_id, block)
SELECT head, count(*) AS blocks, count(number) AS numbered, max(number) AS number, count(mark) AS marked FROM f GROUP BY head""")
def line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    found = assemble.blocks(lines, ["doc_id"], "pos", _HEAD, {"number": _NUMBER, "mark": _MARK})
    return found.groupBy("head").agg(F.count("*").alias("blocks"), F.count("number").alias("numbered"), F.max("number").alias("number"), F.count("mark").alias("marked"))


@query("""SELECT event_id, CAST(count(value) OVER w AS BIGINT) AS n, round(max(value) OVER w, 6) AS highest FROM (SELECT *, epoch(ts) AS sec FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)""")
def recent_ring(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "value")
    ring = assemble.recent(rows, ["user_id"], "at", 7200, "value")
    return ring.select("event_id", F.size("recent").cast("long").alias("n"), F.round(F.array_max("recent"), 6).alias("highest"))


_CLAUSES = "(SELECT CAST(1 + event_id % 4 AS BIGINT) AS words, value AS ttfa, value / 10 AS seconds, event_type FROM events WHERE value IS NOT NULL)"


def _clauses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("value is not null").select((1 + F.col("event_id") % 4).alias("words"), F.col("value").alias("ttfa"), (F.col("value") / 10).alias("seconds"))


@query(f"SELECT words, count(*) AS n, quantile_disc(ttfa, 0.5) AS p50, quantile_disc(ttfa, 0.95) AS p95, round(median(seconds), 6) AS audio_s FROM {_CLAUSES} GROUP BY words")
def first_audio_by_clause(spark: SparkSession, sf: str) -> DataFrame:
    return stats.by_clause(_clauses(spark, sf), "words", "ttfa", "seconds").withColumn("audio_s", F.round("audio_s", 6))


@query(f"SELECT quantile_disc(ttfa, 0.5) AS p50, quantile_disc(ttfa, 0.5) < 60 AS passed FROM {_CLAUSES} WHERE words = (SELECT max(words) FROM {_CLAUSES})")
def longest_clause_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return stats.longest_within(stats.by_clause(_clauses(spark, sf), "words", "ttfa", "seconds"), 60.0)


@query("""SELECT label, strength, count(*) AS n, round(min(x), 9) AS least, round(max(x), 9) AS most FROM (SELECT label, CASE WHEN i < 0.35 THEN 'slightly' WHEN i < 0.7 THEN '' ELSE 'clearly' END AS strength,
CASE WHEN label = 'neutral' THEN 0.25::DOUBLE ELSE 0.25::DOUBLE + 0.55::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, i)) END AS x FROM (SELECT CASE WHEN event_type = 'click' THEN 'neutral' ELSE event_type END AS label, value / 100 AS i FROM events WHERE value IS NOT NULL)) GROUP BY 1, 2""")
def voice_directions(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("event_type") == "click", "neutral").otherwise(F.col("event_type"))
    rows = table(spark, sf, "events").filter("value is not null").select(label.alias("label"), (F.col("value") / 100).alias("i"))
    spoken = rows.select("label", lb.strength(F.col("i")).alias("strength"), lb.exaggeration(F.col("label"), F.col("i")).alias("x"))
    return spoken.groupBy("label", "strength").agg(F.count("*").alias("n"), F.round(F.min("x"), 9).alias("least"), F.round(F.max("x"), 9).alias("most"))


#: Names of corpora as documents may carry them: every known one in some spelling, and sources that are none.
_CORPORA = [*(n for names in lb.SPEECH_KINDS.values() for n in names), "unheard-of"]
_CORPUS = f"list_value({', '.join(f"'{n}'" for n in _CORPORA)})[1 + doc_id % {len(_CORPORA)}]"
_KINDS = "(VALUES " + ", ".join(f"('{n}', '{kind}')" for kind, names in lb.SPEECH_KINDS.items() for n in names) + ") AS k(name, kind)"


@query(f"""WITH c AS (SELECT CASE n_chars % 3 WHEN 0 THEN upper({_CORPUS}) WHEN 1 THEN ' ' || {_CORPUS} || ' ' || source ELSE source END AS corpus FROM documents)
SELECT corpus, kind, CASE kind WHEN 'acted' THEN true WHEN 'natural' THEN false END AS acted, count(*) AS n FROM (SELECT corpus, (SELECT max(kind) FROM {_KINDS} WHERE starts_with(lower(trim(corpus)), name)) AS kind FROM c) GROUP BY 1, 2, 3""")
def speech_kinds(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _CORPORA)), (1 + F.col("doc_id") % len(_CORPORA)).cast("int"))
    corpus = F.when(F.col("n_chars") % 3 == 0, F.upper(name)).when(F.col("n_chars") % 3 == 1, F.concat(F.lit(" "), name, F.lit(" "), "source")).otherwise(F.col("source"))
    rows = table(spark, sf, "documents").select(corpus.alias("corpus"))
    return rows.select("corpus", lb.speech_kind(F.col("corpus")).alias("kind"), lb.acted(F.col("corpus")).alias("acted")).groupBy("corpus", "kind", "acted").agg(F.count("*").alias("n"))


_H1, _TITLE = "<h1>([^<]*)</h1>", "<title>([^<]*)</title>"


@query(f"SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '{_H1}', 1)), ''), nullif(trim(regexp_extract(html, '{_TITLE}', 1)), ''), nullif(trim(url), ''), '') AS name FROM pages")
def first_text_of_page(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.regexp_extract("html", _H1, 1), F.regexp_extract("html", _TITLE, 1), F.col("url")]
    return table(spark, sf, "pages").select("page_id", tx.first_text(parts).alias("name"))


_TAGGED_AT = "(?i)" + tx.TAG


@query(f"""SELECT conv_id, turn, CASE WHEN f THEN lower(regexp_extract(reply, '{_TAGGED_AT}', 1)) ELSE 'neutral' END AS label, round(CASE WHEN f THEN TRY_CAST(regexp_extract(reply, '{_TAGGED_AT}', 2) AS INT) / 9 ELSE 0.5 END, 9) AS intensity,
sha256(CASE WHEN f THEN regexp_replace(regexp_replace(reply, '{_TAGGED_AT}', ''), '^{_SPACE}+', '') ELSE reply END) AS text_sha256 FROM (SELECT *, regexp_matches(reply, '{_TAGGED_AT}') AS f FROM {_REPLIES_SQL})""")
def leading_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = replies(spark, sf).select("conv_id", "turn", tx.leading_tag(F.col("reply")).alias("t"))
    return rows.select("conv_id", "turn", "t.label", F.round("t.intensity", 9).alias("intensity"), F.sha2("t.text", 256).alias("text_sha256"))


@query("SELECT source, CASE WHEN quality <> 1 AND n_chars / 2000.0 >= 0.5 THEN 8.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def hard_negative_weights(spark: SparkSession, sf: str) -> DataFrame:
    rated = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") / 2000.0).alias("score")).join(table(spark, sf, "labels"), "doc_id")
    weighed = assemble.hard_negatives(rated.withColumn("good", F.col("quality") == 1), "score", "good")
    return weighed.groupBy("source", "weight").agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(sum(CASE WHEN sec + 3600 >= 43200 AND sec <= 39600 THEN 1 ELSE 0 END) AS BIGINT) AS inside, count(*) AS n FROM (SELECT user_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS sec FROM events) GROUP BY user_id")
def windows_around_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of an hour that hold the end of a given interval of the day."""
    at = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")
    rows = table(spark, sf, "events").select("user_id", at.alias("start"), (at + 3600).alias("end"))
    labelled = assemble.inside(rows, "start", "end", 39600.0, 43200.0)
    return labelled.groupBy("user_id").agg(F.sum("label").alias("inside"), F.count("*").alias("n"))
