"""Queries on conversations and trees of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dialogue
from ..sources import records
from ..sources.shared import cut, drop_path, named_parts, shared_path
from .base import registry, table

QUERIES, SQL, query = registry()

_RUNS = """(SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)
AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 0 ELSE 1 END AS chg FROM events))"""


@query(f"SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(event_id) AS first_id FROM {_RUNS} GROUP BY 1, 2, 3")
def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = dialogue.runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", F.col("run").cast("long").alias("run"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE turn <= last) WHERE n >= 2""")
def dialogue_trim(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.trim_to_answer(table(spark, sf, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT conv_id, turn, CAST(exchange AS BIGINT) AS exchange FROM (SELECT *, max(exchange) OVER (PARTITION BY conv_id) AS m FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations)) WHERE exchange > m - 2""")
def exchange_history(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.last_exchanges(table(spark, sf, "conversations"), ["conv_id"], "turn", 2).select("conv_id", "turn", F.col("exchange").cast("long").alias("exchange"))


#: Conversations in which some turns are blank and some follow one of their own role.
_TURNS = "(SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'user' ELSE role END AS role, CASE WHEN (conv_id + turn) % 7 = 2 THEN ' ' ELSE text END AS text FROM conversations)"


@query(f"""SELECT conv_id, min(turn) AS turn, role, sha256(string_agg(text, ' ' ORDER BY turn)) AS text_sha256, count(*) AS turns FROM (SELECT *, sum(chg) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM
(SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS chg FROM {_TURNS} WHERE trim(coalesce(text, '')) <> '')) GROUP BY conv_id, run, role""")
def turn_merge(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "if((conv_id + turn) % 3 = 0, 'user', role) as role", "if((conv_id + turn) % 7 = 2, ' ', text) as text")
    return dialogue.merge_turns(turns, ["conv_id"], "turn").select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"), "turns")


@query("""SELECT c.conv_id, c.turn, r.text_sha256 AS answer_sha256 FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM conversations WHERE role = 'user') c
LEFT JOIN (SELECT conv_id, sha256(text) AS text_sha256, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM conversations WHERE role = 'assistant') r ON c.conv_id = r.conv_id AND c.o = r.o""")
def result_pairing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    calls = rows.filter("role = 'user'").select("conv_id", "turn")
    results = rows.filter("role = 'assistant'").select("conv_id", "turn", F.sha2("text", 256).alias("content"))
    return dialogue.pair_results(calls, results, ["conv_id"], "turn").select("conv_id", "turn", F.col("result").alias("answer_sha256"))


#: The documents as trees of replies, eight to a tree: node i answers node (i - 1) // 2, even levels ask, ranks and deletions by number.
_NODES = """(SELECT doc_id // 8 AS tree, doc_id % 8 AS id, CASE WHEN doc_id % 8 > 0 THEN (doc_id % 8 - 1) // 2 END AS parent, CASE WHEN doc_id % 8 IN (0, 3, 4, 5, 6) THEN 'prompter' ELSE 'assistant' END AS role,
CASE WHEN (doc_id // 8) % 4 = 0 THEN NULL ELSE (doc_id + doc_id // 8) % 2 END AS rank, doc_id % 19 = 5 AS deleted, doc_id FROM documents)"""
_TREES_SQL = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM {_NODES}),
kin AS (SELECT c.*, p.role AS asked, count(CASE WHEN c.rank IS NOT NULL AND NOT c.deleted THEN 1 END) OVER (PARTITION BY c.tree, c.parent) AS ranked, min(CASE WHEN NOT c.deleted THEN c.id END) OVER (PARTITION BY c.tree, c.parent) AS first
FROM n c LEFT JOIN n p ON c.tree = p.tree AND c.parent = p.id),
good AS MATERIALIZED (SELECT * FROM kin WHERE NOT deleted AND (parent IS NULL OR asked = 'assistant' OR rank = 0 OR (ranked = 0 AND id = first))),
walk AS (SELECT tree, id, role, 1 AS depth, 'd' || doc_id AS said, CAST('' AS VARCHAR) AS before FROM good WHERE parent IS NULL
UNION ALL SELECT g.tree, g.id, g.role, w.depth + 1, w.said || '|' || 'd' || g.doc_id, w.said FROM walk w JOIN good g ON g.tree = w.tree AND g.parent = w.id)
SELECT CASE role WHEN 'assistant' THEN said ELSE before END AS said FROM walk w WHERE CASE role WHEN 'assistant' THEN NOT EXISTS (SELECT 1 FROM n WHERE n.tree = w.tree AND n.parent = w.id AND NOT n.deleted)
ELSE depth >= 3 AND NOT EXISTS (SELECT 1 FROM good g WHERE g.tree = w.tree AND g.parent = w.id) END"""


@query(_TREES_SQL)
def tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Trees are written as nested JSON, a line each, and read as the conversations on their paths."""
    root = shared_path(spark, "trees")
    nodes = table(spark, sf, "documents").selectExpr(
        "doc_id div 8 as tree", "cast(doc_id % 8 as int) as id", "if(doc_id % 8 in (0, 3, 4, 5, 6), 'prompter', 'assistant') as role",
        "cast(if((doc_id div 8) % 4 = 0, null, (doc_id + doc_id div 8) % 2) as int) as rank", "doc_id % 19 = 5 as deleted", "concat('d', doc_id) as text",
    )
    by_id = nodes.groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("role", "rank", "deleted", "text")))).alias("m"))

    def node(i: int) -> Column:
        own = F.try_element_at("m", F.lit(i))
        inner = [node(k) for k in (2 * i + 1, 2 * i + 2) if k < 8] or [F.lit(None).cast("string")]
        head = F.to_json(F.struct(own["role"].alias("role"), own["rank"].alias("rank"), own["deleted"].alias("deleted"), own["text"].alias("text"), F.lit("en").alias("lang")))
        return F.when(own.isNotNull(), F.concat(F.rtrim(head, F.lit("}")), F.lit(', "replies": ['), F.array_join(F.array(*inner), ", "), F.lit("]}")))

    try:
        by_id.filter("m[0] is not null").select(F.concat(F.lit('{"prompt": '), node(0), F.lit("}")).alias("value")).write.text(f"{root}/written")
        named_parts(spark, f"{root}/written", root, "{}.ready.trees.jsonl")
        made = records.reply_trees(spark, root)
        return cut(made.select(F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("said")))
    finally:
        drop_path(spark, root)
