"""Queries of corpus preparation: cleaning, dedup, splits, accounts, licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import budgets, corpus, prep, splits
from ..sources.shared import drop_path, shared_path
from .base import registry, spread, table

QUERIES, SQL, query = registry()


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "source", "lang"))


#: SQL for the cleaned text: pictographs out, white space trimmed (RE2 syntax).
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_EMOJI = tx.EMOJI
_CLEAN = f"regexp_replace(regexp_replace(coalesce(text, ''), '{_EMOJI}', '', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_DOCS = f"(SELECT doc_id, source, lang, {_CLEAN} AS text, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS src_rank FROM documents)"
_BUCKET = "CAST('0x' || left(sha256('0:' || text), 12) AS BIGINT) % 1000"
_PREPARED = f"(SELECT *, row_number() OVER (PARTITION BY text ORDER BY src_rank, doc_id) = 1 AS is_first, CASE WHEN {_BUCKET} < 50 THEN 'val' ELSE 'train' END AS split FROM {_DOCS} WHERE text <> '')"


@query(f"""SELECT source, lang, count(*) FILTER (is_first) AS n, count(*) FILTER (NOT is_first) AS duplicates, count(*) FILTER (is_first AND split = 'train') AS train,
count(*) FILTER (is_first AND split = 'val') AS val FROM {_PREPARED} GROUP BY source, lang""")
def prep_dedup_split_stats(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.prep_accounts(_documents(spark, sf))


@query(f"SELECT source, count(*) AS duplicates FROM {_PREPARED} WHERE NOT is_first GROUP BY source")
def dedup_duplicates_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.prepared(_documents(spark, sf)).filter("not is_first").groupBy("source").agg(F.count("*").alias("duplicates"))


@query(f"SELECT doc_id, source, split FROM {_PREPARED} WHERE is_first")
def prep_kept_rows(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.prepared(_documents(spark, sf)).filter("is_first").select("doc_id", "source", "split")


@query("""SELECT source, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY src_rank, doc_id) AS d FROM
(SELECT doc_id, source, text, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS src_rank, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5) WHERE d = 1 GROUP BY source""")
def prep_cap_then_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("src_rank", F.regexp_extract("source", r"(\d+)$", 1).cast("int"))
    capped = corpus.capped_by_source(docs, "source", ["doc_id"], 5).withColumn("digest", F.sha2("text", 256)).drop("text")
    return corpus.first_of_each(capped, "digest", ["src_rank", "doc_id"]).filter("is_first").groupBy("source").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, sha256({_CLEAN}) AS clean_sha256, length({_CLEAN}) AS clean_chars FROM documents")
def text_clean(spark: SparkSession, sf: str) -> DataFrame:
    clean = tx.clean(F.col("text"))
    return _documents(spark, sf).select("doc_id", F.sha2(clean, 256).alias("clean_sha256"), F.length(clean).cast("long").alias("clean_chars"))


_SPOKEN = f"regexp_replace(regexp_replace(replace({_CLEAN}, '**', ''), '{_SPACE}+', ' ', 'g'), '^ +| +$', '', 'g')"


@query(f"SELECT doc_id, sha256({_SPOKEN}) AS spoken_sha256 FROM documents")
def text_spoken(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", F.sha2(tx.spoken(F.col("text")), 256).alias("spoken_sha256"))


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({t}), '\p{{Cf}}', '', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}'']', ' ', 'g'), ' +'), lambda w: w <> '')"


@query("SELECT doc_id, CAST(len(" + _WORDS.format(t="text") + ") AS BIGINT) AS n_words, sha256(array_to_string(" + _WORDS.format(t="text") + ", ' ')) AS words_sha256 FROM documents")
def norm_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    words = tx.spoken_words(F.col("text"))
    return _documents(spark, sf).select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.sha2(F.array_join("w", " "), 256).alias("words_sha256"))


@query("SELECT doc_id, CAST(CAST('0x' || left(sha256('0:' || CAST(doc_id AS VARCHAR)), 12) AS BIGINT) % 1000 AS INT) AS bucket FROM documents")
def text_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.seeded_bucket(F.col("doc_id").cast("string")).alias("bucket"))


_SIDE = "(SELECT c_custkey, c_mktsegment, CAST('0x' || left(sha256(c_mktsegment || ':' || c_custkey), 8) AS BIGINT) % 100 AS b FROM customer)"


@query(f"SELECT c_mktsegment, CASE WHEN b < 15 THEN 'val' WHEN b < 30 THEN 'test' ELSE 'train' END AS side, count(*) AS n FROM {_SIDE} GROUP BY 1, 2")
def speaker_split(spark: SparkSession, sf: str) -> DataFrame:
    key = splits.speaker(F.col("c_mktsegment"), F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").select("c_mktsegment", splits.speaker_side(key).alias("side")).groupBy("c_mktsegment", "side").agg(F.count("*").alias("n"))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("speaker"), F.col("o_totalprice").alias("seconds"), "o_orderstatus")


_SPLIT = "(SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'eval' WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'leak' ELSE 'train' END AS split FROM orders)"


@query(f"SELECT split, count(*) AS n, round(sum(o_totalprice) / 3600, 2) AS hours, count(DISTINCT o_custkey) AS speakers FROM {_SPLIT} GROUP BY split")
def split_leak_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    plan = splits.plan_split(_orders(spark, sf), F.col("o_orderstatus") == "F", ["o_orderkey"])
    return splits.summary(plan, ["split"]).withColumn("hours", F.round("hours", 2))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice) / 3600, 2) AS hours, count(DISTINCT o_custkey) AS speakers FROM orders GROUP BY 1")
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return splits.summary(_orders(spark, sf), ["o_orderstatus"]).withColumn("hours", F.round("hours", 2))


@query("""SELECT 'by row' AS split, count(*) AS leaking FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) FILTER (o_orderstatus <> 'F') > 0)
UNION ALL SELECT 'by speaker', count(*) FROM (SELECT o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders h WHERE h.o_custkey = o.o_custkey AND h.o_orderstatus = 'F')) t JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') e ON t.o_custkey = e.o_custkey""")
def split_leak_check(spark: SparkSession, sf: str) -> DataFrame:
    """Speakers on both sides of a split by rows, which leaks, and of one by speakers, which does not."""
    rows, held = _orders(spark, sf), F.col("o_orderstatus") == "F"
    by_row = splits.leaks(rows.withColumn("split", F.when(held, "eval").otherwise("train")))
    by_speaker = splits.leaks(splits.plan_split(rows, held, ["o_orderkey"]))
    count = lambda df, name: df.agg(F.lit(name).alias("split"), F.count("*").alias("leaking"))
    return count(by_row, "by row").unionByName(count(by_speaker, "by speaker"))


_ORDERED = "(SELECT o_orderkey, o_totalprice, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('0|' || o_orderkey), o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT * FROM {_ORDERED}), fold AS (
SELECT c_mktsegment, 0 AS r, 0.0::DOUBLE AS spent, 0::BIGINT AS kept FROM (SELECT DISTINCT c_mktsegment FROM o)
UNION ALL SELECT o.c_mktsegment, o.r, CASE WHEN spent + o_totalprice <= 3600000 THEN spent + o_totalprice ELSE spent END, kept + CASE WHEN spent + o_totalprice <= 3600000 THEN 1 ELSE 0 END
FROM fold JOIN o ON o.c_mktsegment = fold.c_mktsegment AND o.r = fold.r + 1)
SELECT c_mktsegment, max(kept) AS kept, round(max(spent), 2) AS seconds FROM fold GROUP BY 1""")
def hours_cap_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_totalprice").alias("seconds"), "c_mktsegment")
    kept = budgets.capped(rows, "seconds", 3_600_000.0, ["c_mktsegment"], 0, ["o_orderkey"])
    return kept.groupBy("c_mktsegment").agg(F.count("*").alias("kept"), F.round(F.sum("seconds"), 2).alias("seconds"))


_BY_SOURCE = "(SELECT doc_id, coalesce(source, '-') AS source, n_chars, row_number() OVER (PARTITION BY coalesce(source, '-') ORDER BY sha256('3|' || doc_id), doc_id) AS r FROM documents)"
_SHARES = "(SELECT source, CAST(floor(1000000.0::DOUBLE * (total / 4.0::DOUBLE) * (1.0::DOUBLE / k)) AS BIGINT) / 1000000.0::DOUBLE AS budget FROM (SELECT DISTINCT coalesce(source, '-') AS source FROM documents), (SELECT sum(n_chars) AS total, count(DISTINCT coalesce(source, '-')) AS k FROM documents))"


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT b.source, b.r, b.n_chars, budget FROM {_BY_SOURCE} AS b JOIN {_SHARES} AS s ON b.source = s.source), fold AS (
SELECT source, 0::BIGINT AS r, 0::HUGEINT AS spent, 0::BIGINT AS kept FROM (SELECT DISTINCT source FROM o)
UNION ALL SELECT o.source, o.r, CASE WHEN spent + n_chars <= budget THEN spent + n_chars ELSE spent END, kept + CASE WHEN spent + n_chars <= budget THEN 1 ELSE 0 END
FROM fold JOIN o ON o.source = fold.source AND o.r = fold.r + 1)
SELECT source, max(kept) AS kept, CAST(max(spent) AS BIGINT) AS n_chars FROM fold GROUP BY 1""")
def budget_shared_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of all characters, shared evenly by the sources."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("source"), "n_chars")
    names = [r["source"] for r in docs.select("source").distinct().collect()]
    total = docs.agg(F.sum("n_chars")).first()[0] or 0
    kept = budgets.shared_out(docs, "n_chars", total / 4.0, {name: 1.0 / len(names) for name in names}, "source", 3, ["doc_id"])
    return kept.groupBy("source").agg(F.count("*").alias("kept"), F.sum("n_chars").alias("n_chars"))


@query("""SELECT source, lang, CAST(grouping_id(source, lang) AS BIGINT) AS gid, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang), ())""")
def grouping_sets_totals(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.accounts(table(spark, sf, "documents"), ["source", "lang"]).select("source", "lang", F.col("gid").cast("long").alias("gid"), "n")


@query("SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def kind_partition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))


#: A small licence table for the sources of documents.
_LICENCES = [("src0", "CC-BY", "yes"), ("src1", "CC-BY-NC", "no"), ("src2", "unknown terms", "unclear"), ("src3", "MIT", "yes"), ("src4", "CC0", "yes")]
_LICENCE_SQL = "(VALUES ('src0', 'CC-BY', 'yes'), ('src1', 'CC-BY-NC', 'no'), ('src2', 'unknown terms', 'unclear'), ('src3', 'MIT', 'yes'), ('src4', 'CC0', 'yes')) AS m(name, license, weights_publishable)"


def _licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LICENCES, "name string, license string, weights_publishable string")


@query(f"""SELECT lang, CASE max(CASE coalesce(weights_publishable, 'unclear') WHEN 'yes' THEN 1 WHEN 'unclear' THEN 2 ELSE 3 END) WHEN 1 THEN 'yes' WHEN 2 THEN 'unclear' ELSE 'no' END AS verdict,
count(*) FILTER (m.name IS NULL) AS unknown FROM documents LEFT JOIN {_LICENCE_SQL} ON source = m.name GROUP BY lang""")
def licence_verdict(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.licensed(table(spark, sf, "documents").select("source", "lang"), _licences(spark))
    return rows.groupBy("lang").agg(corpus.verdict().alias("verdict"), F.count_if(F.col("licence") == "unknown").alias("unknown"))


@query(f"SELECT source, count(*) AS n FROM documents WHERE source IN (SELECT name FROM {_LICENCE_SQL} WHERE weights_publishable = 'yes') GROUP BY source")
def filter_publishable(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.publishable(table(spark, sf, "documents").select("source"), _licences(spark)).groupBy("source").agg(F.count("*").alias("n"))


#: The same table as a manifest, in the order of priority and name: src3, src0, src2, src4; src1 is refused.
_PRIORITY = "CASE source WHEN 'src3' THEN 0 WHEN 'src0' THEN 1 WHEN 'src2' THEN 2 WHEN 'src4' THEN 3 END"


@query(f"""WITH d AS (SELECT doc_id, source, {_CLEAN} AS text, {_PRIORITY} AS p, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE source IN ('src0', 'src2', 'src3', 'src4')),
k AS (SELECT *, CASE WHEN text = '' THEN 'blank' WHEN length(text) > 20000 THEN 'long' END AS dropped FROM d WHERE source <> 'src0' OR r <= 20),
f AS (SELECT *, dropped IS NULL AND row_number() OVER (PARTITION BY text, dropped ORDER BY p, doc_id) = 1 AS is_first, CASE WHEN {_BUCKET} < 50 THEN 'val' ELSE 'train' END AS split FROM k)
SELECT source, count(*) FILTER (is_first) AS n, count(*) FILTER (is_first AND split = 'train') AS train, count(*) FILTER (is_first AND split = 'val') AS val,
count(*) FILTER (dropped IS NULL AND NOT is_first) AS duplicates, count(*) FILTER (dropped = 'blank') AS blank, count(*) FILTER (dropped = 'long') AS long FROM f GROUP BY source""")
def prep_receipt(spark: SparkSession, sf: str) -> DataFrame:
    """The whole preparation, files and all; what its receipt says by source."""
    manifest = spark.createDataFrame([(n, lic, ["NC"] if w == "no" else [], w, 1 if n == "src3" else 2) for n, lic, w in _LICENCES], "name string, license string, flags array<string>, weights_publishable string, priority int")
    chosen = prep.plan(manifest, [n for n, _, _ in _LICENCES], F.lit(True))
    out = shared_path(spark, "prepared")
    try:
        stats = prep.prepare(_documents(spark, sf), chosen, out, ["doc_id"], {"src0": 20}, [("long", F.length("text") > 20_000)], ["en", "de", "fr", "es"])
    finally:
        drop_path(spark, out)
    rows = [(name, s["n"], s["train"], s["val"], s["duplicates"], s["dropped"].get("blank", 0), s["dropped"].get("long", 0)) for name, s in stats["sources"].items() if s["n"] + s["duplicates"] + sum(s["dropped"].values())]
    return spark.createDataFrame(rows, "source string, n long, train long, val long, duplicates long, blank long, long long")


@query("""SELECT coalesce(CASE WHEN length(trim(text)) = 0 THEN 'empty_text' WHEN regexp_matches(text, '<[^<>]{0,40}>') THEN 'annotator_tag' WHEN n_chars > 5000 THEN 'too_long' WHEN n_chars < 100 THEN 'too_short' END, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1""")
def skip_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("empty_text", F.length(F.trim("text")) == 0), ("annotator_tag", tx.annotator_tag(F.col("text"))), ("too_long", F.col("n_chars") > 5000), ("too_short", F.col("n_chars") < 100)]
    rows = corpus.skip_reasons(table(spark, sf, "documents").select("text", "n_chars"), rules)
    return rows.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_HTML = f"regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


@query(f"SELECT page_id, length({_HTML}) AS chars, sha256({_HTML}) AS text_sha256 FROM pages")
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    text = tx.html_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(text).cast("long").alias("chars"), F.sha2(text, 256).alias("text_sha256"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS n_links, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1)[1:5], ' ') AS links FROM pages""")
def html_regex_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.array_join(tx.html_links(F.col("html")), " ").alias("links"))


@query("""SELECT doc_id FROM (SELECT doc_id, sha256('7|' || doc_id) AS h FROM documents) ORDER BY h, doc_id LIMIT 50""")
def seeded_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return splits.seeded_sample(table(spark, sf, "documents").select("doc_id"), 50, ["doc_id"], 7)


@query("SELECT source, CAST(ceil(quantile_disc(n_chars, 0.95) / 64.0) * 64 AS BIGINT) AS max_length FROM documents GROUP BY source")
def choose_max_length(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ranks, stats

    lengths = ranks.nearest_ranks(table(spark, sf, "documents").select("source", "n_chars"), ["source"], "n_chars", {"p95": 0.95})
    return lengths.select("source", stats.round_up(F.col("p95")).alias("max_length"))
