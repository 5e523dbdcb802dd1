"""Queries of the corpus readers. Each writes rows made from the documents in the format of a corpus to the shared folder, reads
them with its reader, and gives what the records hold; the SQL makes the records straight from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..sources import records
from ..sources.shared import cut, drop_path, named_parts, shared_path
from .base import registry, table

QUERIES, SQL, query = registry()


def _told(spark: SparkSession, sf: str, corpus: str, folder: str, *columns: str, together: str | None = None) -> DataFrame:
    """lang, kind, roles, said and calls of every record that a corpus's reader makes of rows with the columns given. Rows of one
    value of together are in one file, in the order of doc_id."""
    root, docs = shared_path(spark, "corpus"), table(spark, sf, "documents")
    if together is not None:
        docs = docs.repartition(max(4, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.expr(together)).sortWithinPartitions("doc_id")
    docs.selectExpr(*columns).write.json(f"{root}/written")
    named_parts(spark, f"{root}/written", f"{root}/{folder}", "train-{}.jsonl")
    made = records.READERS[corpus](spark, root)
    calls = F.flatten(F.transform("messages", lambda m: F.coalesce(F.transform(m["tool_calls"], lambda c: F.concat(c["id"], F.lit("="), c["name"], c["arguments"])), F.array().cast("array<string>"))))
    done = cut(made.select(
        "lang", "kind", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "|").alias("said"), F.array_join(calls, ";").alias("calls"),
    ))
    drop_path(spark, root)
    return done


def _sql(lang: str, kind: str, roles: str, said: str, where: str = "true", calls: str = "''") -> str:
    return f"SELECT {lang} AS lang, {kind} AS kind, {roles} AS roles, {said} AS said, {calls} AS calls FROM documents WHERE {where}"


@query(_sql("'hinglish'", "'chat'", "'user,assistant'", "'ask ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || chr(10) || source END || '|say ' || n_chars", "doc_id % 5 <> 0"))
def read_instructions(spark: SparkSession, sf: str) -> DataFrame:
    return _told(spark, sf, "databricks-dolly-15k-hinglish", "data", "concat('ask ', doc_id) as codemix_instruction", "if(doc_id % 3 = 0, '', source) as codemix_input", "if(doc_id % 5 = 0, ' ', concat('say ', n_chars)) as codemix_output")


@query(_sql("'hinglish'", "'chat'", "'system,user,assistant'", f"'{records.COMPREHENSION}|from ' || doc_id || '|to ' || source", "doc_id % 2 = 0"))
def read_human_translations(spark: SparkSession, sf: str) -> DataFrame:
    return _told(spark, sf, "hinglish-top", "data", "concat('to ', source) as en", "concat('from ', doc_id) as hi_en", "if(doc_id % 2 = 0, 'human', 'made') as generated_by")


@query(_sql("'hinglish'", "'chat'", "'system,user,assistant'", f"'{records.COMPREHENSION}|from ' || doc_id || '|to ' || source", "doc_id % 4 <> 1"))
def read_social_translations(spark: SparkSession, sf: str) -> DataFrame:
    return _told(spark, sf, "phinc", ".", "concat(' from ', doc_id) as Sentence", "if(doc_id % 4 = 1, null, concat('to ', source)) as English_Translation")


@query(_sql("'en'", "'chat'", "'system,user,assistant'", "'Your persona:' || chr(10) || '- likes ' || source || chr(10) || '- number ' || doc_id || '|hello ' || doc_id || '|well met again'", "doc_id % 3 <> 0"))
def read_personas(spark: SparkSession, sf: str) -> DataFrame:
    talk = "concat('User 1: hello ', doc_id, '\\n**User 2:** well met', '\\nagain\\n')"
    return _told(spark, sf, "synthetic-persona-chat", "data", "'x' as `user 1 personas`", "concat('likes ', source, '\\n\\nnumber ', doc_id) as `user 2 personas`", f"if(doc_id % 3 = 0, 'no turns', {talk}) as `Best Generated Conversation`")


@query(_sql("'en'", "'chat'", "'user,assistant'", "'hi ' || doc_id || '|hey there'", "doc_id % 4 = 0"))
def read_reactions(spark: SparkSession, sf: str) -> DataFrame:
    """Another relation, three speakers, a role for a name and uneven lists drop out; a last question is cut."""
    speakers = "case doc_id % 4 when 1 then array('Ann', 'Waiter', 'Waiter', 'Ann') when 2 then array('Ann', 'Bo', 'Cy', 'Ann') else array('Ann', 'Bo', 'Bo', 'Ann') end as speakers"
    return _told(spark, sf, "soda", ".", "if(doc_id % 4 = 3, 'xNeed', 'xReact') as relation", speakers, "array(concat('hi ', doc_id), 'hey', 'there', 'and?') as dialogue")


@query(_sql("'en'", "'chat'", "'user,assistant'", "'a ' || doc_id || '|b'", "doc_id % 7 IN (1, 3, 5)"))
def read_heavy_dialogues(spark: SparkSession, sf: str) -> DataFrame:
    return _told(spark, sf, "dailydialog", "data", "array(concat('a ', doc_id), 'b', 'c') as dialog", "array(0, cast(doc_id % 7 as int), 0) as emotion")


@query(_sql("CASE WHEN doc_id % 3 = 0 THEN 'hi' ELSE 'hinglish' END", "'chat'", "'user,assistant'", "'one ' || doc_id || '|two three'", "doc_id % 3 <> 2"))
def read_script_dialogues(spark: SparkSession, sf: str) -> DataFrame:
    said = "array(struct('A' as speaker, concat('**one** ', doc_id) as text), struct('B' as speaker, 'two' as text), struct('B' as speaker, 'three' as text)) as Conversation"
    return _told(spark, sf, "indictalk-hindi-config", "hindi", "element_at(array('Native', 'Romanized', 'Other'), cast(doc_id % 3 + 1 as int)) as Script", said)


@query(_sql("'en'", "'emotion_text'", "'user,assistant'", "'felt ' || doc_id || '|' || CASE WHEN doc_id % 30 = 17 THEN 'happy' ELSE 'neutral' END", "doc_id % 30 IN (17, 27)"))
def read_fine_emotions(spark: SparkSession, sf: str) -> DataFrame:
    """Of the numbers 17 (joy) and 27 (none) both give one tag; two tags in one row, or none known, give no record."""
    one = "if(doc_id % 30 in (17, 27), array(cast(doc_id % 30 as int)), array(17, 2)) as labels"
    return _told(spark, sf, "goemotions", "simplified", "concat('felt ', doc_id) as text", one)


@query(_sql("'hi'", "'emotion_text'", "'user,assistant'", "'felt ' || doc_id || '|' || CASE doc_id % 4 WHEN 0 THEN 'neutral' ELSE 'angry' END", "doc_id % 4 IN (0, 1)"))
def read_plain_emotions(spark: SparkSession, sf: str) -> DataFrame:
    felt = "case doc_id % 4 when 0 then array() when 1 then array('anger') when 2 then array('fear') else array('anger', 'joy') end as emotions"
    return _told(spark, sf, "brighter-hindi-emotion-categories", "hin", "concat('felt ', doc_id) as text", felt)


@query(_sql("'en'", "'tool_call'", "'user,assistant'", "'do ' || doc_id || '|'", "doc_id % 3 <> 0", """'call_0=f{"n": ' || doc_id || '};call_1=f{"n": ' || n_chars || '}'"""))
def read_parallel_calls(spark: SparkSession, sf: str) -> DataFrame:
    answers = """concat('[{"name": "f", "arguments": {"n": ', doc_id, '}}, {"name": "f", "arguments": {"n": ', n_chars, '}}]')"""
    return _told(spark, sf, "xlam-function-calling-60k", ".", "concat('do ', doc_id) as query", f"if(doc_id % 3 = 0, 'none', {answers}) as answers", """'[{"name": "f", "parameters": {"n": {"type": "int"}}}]' as tools""")


@query(_sql("'en'", "CASE doc_id % 5 WHEN 0 THEN 'tool_call' ELSE 'chat' END", "CASE doc_id % 5 WHEN 0 THEN 'user,assistant,tool,assistant' ELSE 'system,user,assistant' END",
            """CASE doc_id % 5 WHEN 0 THEN 'go ' || doc_id || '|on it|{"r": 1}|done' ELSE 'be brief|go ' || doc_id || '|no' END""", "doc_id % 5 < 2", """CASE doc_id % 5 WHEN 0 THEN 'call_0=f{"n": ' || doc_id || '}' ELSE '' END"""))  # fmt: skip
def read_tagged_calls(spark: SparkSession, sf: str) -> DataFrame:
    """A call and its result; plain chat; a call without tools, one that does not parse and a result without a call drop out."""
    turn = lambda who, value: f"struct('{who}' as `from`, {value} as value)"
    go = turn("human", "concat('go ', doc_id)")
    call = """concat('on it <tool_call>\\n{"name": "f", "arguments": {"n": ', doc_id, '}}\\n</tool_call>')"""
    result = turn("tool", """'<tool_response>{"content": {"r": 1}}</tool_response>'""")
    rows = {
        0: [turn("system", "'use <tools>[]</tools>'"), go, turn("gpt", call), result, turn("gpt", "'done'"), go], 1: [turn("system", "'be brief'"), go, turn("gpt", "'no'")],
        2: [go, turn("gpt", call)], 3: [go, turn("gpt", "'<tool_call>{oops}</tool_call>'")], 4: [go, result, turn("gpt", "'x'")],
    }
    cases = " ".join(f"when {k} then array({', '.join(v)})" for k, v in rows.items())
    tools = """if(doc_id % 5 in (0, 3), '[{"type": "function", "function": {"name": "f"}}]', if(doc_id % 5 = 1, 'null', '[]')) as tools"""
    return _told(spark, sf, "hermes-function-calling-v1", ".", f"case doc_id % 5 {cases} end as conversations", tools)


@query(_sql("'en'", "CASE doc_id % 3 WHEN 0 THEN 'tool_call' ELSE 'chat' END", "CASE doc_id % 3 WHEN 0 THEN 'user,assistant,tool,assistant' ELSE 'user,assistant' END",
            """CASE doc_id % 3 WHEN 0 THEN 'go ' || doc_id || '||{"r": 1}|fine' ELSE 'hi ' || doc_id || '|yo' END""", "doc_id % 3 < 2", """CASE doc_id % 3 WHEN 0 THEN 'call_0=g{"a": "it''s ' || doc_id || '"}' ELSE '' END"""))  # fmt: skip
def read_transcript_calls(spark: SparkSession, sf: str) -> DataFrame:
    called = r"""concat('USER: go ', doc_id, '\n\n\nASSISTANT: <functioncall> {"name": "g", "arguments": ', '\'{"a": "it\\\'s ', doc_id, '"}\'} <|endoftext|>\n\n\nFUNCTION RESPONSE: {"r": 1}\n\n\nASSISTANT: fine <|endoftext|>')"""
    chat = rf"case doc_id % 3 when 0 then {called} when 1 then concat('USER: hi ', doc_id, '\nASSISTANT: yo\nUSER: cut') else 'FUNCTION RESPONSE: [1]\nASSISTANT: x' end as chat"
    return _told(spark, sf, "glaive-function-calling-v2", ".", """if(doc_id % 3 = 0, 'SYSTEM: use {"name": "g", "parameters": {}}', 'no functions') as system""", chat)


@query(_sql("'en'", "CASE doc_id % 3 WHEN 2 THEN 'chat' ELSE 'tool_call' END", "'user,assistant'", "'ask ' || doc_id || CASE doc_id % 3 WHEN 0 THEN '|Where?' WHEN 1 THEN '|' ELSE '|I can not.' END", "true", """CASE doc_id % 3 WHEN 1 THEN 'call_0=w{"x": ' || doc_id || '}' ELSE '' END"""))
def read_chosen_calls(spark: SparkSession, sf: str) -> DataFrame:
    answer = """case doc_id % 3 when 0 then 'Where?' when 1 then concat('<TOOLCALL>[{"name": "w", "arguments": {"x": ', doc_id, '}}]</TOOLCALL>') else 'I can not.' end"""
    given = """if(doc_id % 3 = 2, array(), array('{"name": "w", "parameters": {"type": "dict", "properties": {"x": {"type": "float"}}}}')) as tools"""
    return _told(spark, sf, "when2call", "train", given, "array(struct('user' as role, concat('ask ', doc_id) as content)) as messages", f"struct('assistant' as role, {answer} as content) as chosen_response")


_NAMED = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(("anger", "JOY", " Sad ", "pleasant surprise", "no such")))


@query(f"SELECT doc_id, coalesce(c.name, '') AS label FROM (SELECT doc_id, coalesce(a.v, key) AS name FROM (SELECT doc_id, translate(lower(trim(CASE doc_id % 5 {_NAMED} END)), ' -', '__') AS key FROM documents) "
       f"LEFT JOIN (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in lb.ALIASES.items())}) AS a(k, v) ON key = a.k) LEFT JOIN (VALUES {', '.join(f'({k!r})' for k in lb.CIRCUMPLEX)}) AS c(name) USING (name)")  # fmt: skip
def canonical_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", lb.canonical(F.expr(f"case doc_id % 5 {_NAMED} end")).alias("label"))


@query("""SELECT 'hinglish' AS lang, 'chat' AS kind, 'user,assistant' AS roles, CASE WHEN n.doc_id IS NOT NULL THEN 'say ' || n.doc_id || '|say ' || d.doc_id ELSE 'say ' || d.doc_id || '|say ' || (d.doc_id - 1) END AS said, '' AS calls
FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1 WHERE d.doc_id % 3 = 1""")
def read_film_dialogues(spark: SparkSession, sf: str) -> DataFrame:
    """Three rows a conversation, their times against their order."""
    said = "named_struct('en', source, 'hi_en', concat('say ', doc_id)) as translation"
    return _told(spark, sf, "cmu-hinglish-dog", "data", "concat('d', doc_id div 3) as date", "'u' as user2_id", "if(doc_id % 3 = 1, 'b', 'a') as uid", "cast(9 - doc_id % 3 as string) as utcTimestamp", said, together="doc_id div 3")
