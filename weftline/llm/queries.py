"""The queries op1_ to op13_ and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chatfmt, exact, mixing, mpeg, pii, quality, resample, runs, secrets, sharding, simhash, substr
from .common import WORD, spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return spread(rows.select(*[c for c in ("doc_id", "text", "source") if c in rows.columns]))


def op1_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.spans(documents(spark, sf_dir)).withColumn("sure", F.filter("spans", lambda c: c["base"]))
    counts = [F.expr(f"cast(size(filter(sure, c -> c.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in pii.KINDS]
    return got.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(pii.written(F.col("sure")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(documents(spark, sf_dir))
    return mix.select(F.col("row.doc_id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op4_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    both = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    return chatfmt.read_back(chatfmt.segments(turns.unionByName(both)))


def op5_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substr.deduplicate_in_batches(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.tokenise(documents(spark, sf_dir))
    return got.select("doc_id", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_binpack_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.assign(documents(spark, sf_dir), 40)
    return got.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(documents(spark, sf_dir), secrets.fit(secrets.labelled_findings(spark)))
    spans = F.array_join(F.transform("secrets", lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"))), ",")
    return got.select(F.col("row.doc_id").alias("doc_id"), F.size("found").cast("long").alias("n_candidates"), F.size("secrets").cast("long").alias("n_secrets"), spans.alias("spans"))


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mpeg.read(mpeg.store(documents(spark, sf_dir)))
    return got.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).cast("long").alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op10_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_salted_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact.deduplicate(documents(spark, sf_dir))
    return got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, those whose doc_id has a CRC-32 divisible by ten (a null doc_id counts as the name null), repeat
    themselves from a word on; their words are joined by one space."""
    h = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "utf-8"))
    g = F.floor(h / 10)

    def repeating(words: Column) -> Column:
        n = F.size(words)
        start = F.pmod(g, n)
        period = 1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < start, i).otherwise(start + F.pmod(i - start, period)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")

    # The words are bound to a name inside transform, so that they are split once a row.
    words = F.array(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    planted = F.transform(words, lambda w: F.when(F.size(w) > 0, repeating(w)))[0]
    got = runs.periodic(documents(spark, sf_dir).withColumn("text", F.when(h % 10 == 0, planted).otherwise(F.col("text"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pigeonring_simhash, op2_weak_pii, op3_pareto_mix, op4_chat_round_trip, op5_fingerprint_index, op6_tree_bpe, op7_binpack_shards, op8_forest_secrets, op9_mpeg_audio, op10_boosted_quality, op11_salted_exact_dedup, op12_periodic_runs, op13_importance_resampling)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The mix without intervals: one running sum a source.
_MIX = f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY source, doc_id, coalesce(text, '')) - 1 AS copy FROM documents),
k AS (SELECT *, greatest(0, CAST(floor(log2(greatest(size, 1) / 1024.0::DOUBLE)) AS INT)) AS klass FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN level >= ratio THEN 2.0::DOUBLE * source_size ELSE (SELECT level FROM l WHERE level < ratio ORDER BY ratio, level LIMIT 1) * weight END AS target FROM l),
c AS (SELECT source, klass, CAST(sum(size) AS BIGINT) AS words, pow(2.0::DOUBLE, -0.5::DOUBLE * klass) AS f FROM k GROUP BY source, klass),
a AS (SELECT t.*, c.klass, c.words, c.f, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY klass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / nullif(sum(words * f) OVER (PARTITION BY c.source ORDER BY klass ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS alpha FROM t JOIN c ON t.source IS NOT DISTINCT FROM c.source),
e AS (SELECT *, coalesce(alpha * f >= 2, false) OR target >= 2.0::DOUBLE * source_size AS whole FROM a),
x AS (SELECT *, CASE WHEN whole THEN 2.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(2.0::DOUBLE, coalesce(first_value(CASE WHEN NOT whole THEN alpha END IGNORE NULLS) OVER (PARTITION BY source ORDER BY klass ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) * f)) END AS expected FROM e),
p AS (SELECT *, CAST(floor(expected) AS INT) AS sure, expected - floor(expected) AS p, target - sum(words * CAST(floor(expected) AS INT)) OVER (PARTITION BY source) AS missing FROM x),
u AS (SELECT *, (CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix:' || digest || ':' || copy), 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM k),
q AS (SELECT u.doc_id, u.source, u.size, digest, copy, source_size, target, sure, p, missing, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source AND u.klass = p.klass),
o AS (SELECT *, CASE WHEN p > 0 THEN sum(size) OVER (PARTITION BY source, p > 0 ORDER BY q, doc_id NULLS FIRST, size, digest, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS reach FROM q),
g AS (SELECT source, any_value(missing) - coalesce(max(reach) FILTER (reach <= missing), 0) AS gap FROM o GROUP BY source),
m AS (SELECT o.source, min(struct_pack(off := abs(size - gap), q := q, doc_id := doc_id, digest := digest, copy := copy)) AS c FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source WHERE p > 0 AND reach > missing AND abs(size - gap) < gap GROUP BY o.source)
SELECT o.doc_id, size, source_size, target, CAST(size * (sure + CASE WHEN p > 0 AND (reach <= missing OR (q = m.c.q AND o.doc_id IS NOT DISTINCT FROM m.c.doc_id AND o.digest = m.c.digest AND o.copy = m.c.copy)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o LEFT JOIN m ON o.source IS NOT DISTINCT FROM m.source"""

_CHAT = r"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
b AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM t),
f AS (SELECT *, CASE WHEN contains(x, '</turn') OR contains(x, '<turn') THEN replace(replace(replace(x, '\', '\\'), '</turn', '<\/turn'), '<turn', '<\turn') ELSE x END AS body FROM b)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
CAST(coalesce(sum(length(x)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(17 + length(r) + length(body)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""

_SUBSTRINGS = f"""WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS k, {_WORDS} AS w FROM documents),
win AS (SELECT k, s, array_to_string(w[s:s + 19], ' ') AS t FROM d, unnest(range(1, len(w) - 18)) AS u(s)),
dup AS (SELECT k, s FROM (SELECT k, s, row_number() OVER (PARTITION BY t ORDER BY k, s) AS r FROM win) WHERE r > 1),
cov AS (SELECT DISTINCT k, s + i AS p FROM dup, range(20) AS r(i)),
word AS (SELECT k, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT k, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN cov USING (k, p) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (k)"""


_EXACT = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express over whole tables. XXH64, byte pairs, MPEG, trees and packing
    are beyond it; tests/llm holds those queries against brute force."""
    return {"op3_pareto_mix": _MIX, "op4_chat_round_trip": _CHAT, "op5_fingerprint_index": _SUBSTRINGS, "op11_salted_exact_dedup": _EXACT}
