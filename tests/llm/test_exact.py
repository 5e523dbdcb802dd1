import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import exact, queries

SCHEMA = "doc_id long, text string, n long, keep_id string, salt int, digest binary"


def brute(rows):
    """Sorted (doc_id, keep_id, group_size, kept) by text; of equal doc_ids one is kept."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for ids in groups.values():
        ids.sort(key=lambda i: (i is not None, i or 0))
        out += [(i, ids[-1], len(ids), j + 1 == len(ids)) for j, i in enumerate(ids)]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    texts = ["the hot text " * 200, "a", "a ", "A", "é", "é", "", None, "\n", *(f"text {i}" for i in range(60))]
    ids = [rng.choice([None, 7, i, i]) for i in range(n)]
    return [(i, texts[0] if rng.random() < 0.4 else rng.choice(texts)) for i in ids]


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("digest", [exact.sha256, lambda text: F.crc32(text.cast("binary")) % 5, lambda text: F.lit("same")])
def test_equals_brute_force_whatever_the_digest(spark, digest):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, 1, "x", 2, b"") for i, t in rows], SCHEMA).repartition(9)
    assert found(exact.deduplicate(docs, digest, salts=3)) == brute(rows)


def test_query_equals_brute_force_and_kept_keeps_the_columns(spark, tmp_path):
    rows = corpus(2)
    docs = spark.createDataFrame([(i, t, 1, "x", 2, b"") for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_salted_exact_dedup(spark, str(tmp_path))
    assert found(got) == brute(rows)
    stays = exact.kept(docs.repartition(7))
    assert stays.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in stays.collect()) == sorted((i is not None, i or 0, t) for t, i in {(t or "", k) for (i, t), k in zip(rows, [max((j for j, u in rows if (u or "") == (t or "") and j is not None), default=None) for i, t in rows])})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.deduplicate(docs).count() == 0 and exact.kept(docs).count() == 0


def test_no_key_holds_a_hot_group(spark):
    """The parts that go back to the rows hold a salt's share of the group."""
    docs = spark.range(0, 6000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("hot " * 50).alias("text"))
    assert exact.combined(docs.withColumn("digest", exact.sha256(F.col("text")))).count() == 1
    got = exact.deduplicate(docs)
    assert got.filter("kept").count() == 1 and got.agg(F.min("group_size"), F.max("group_size")).first() == (6000, 6000)
