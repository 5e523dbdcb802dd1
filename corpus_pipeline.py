"""A corpus pipeline in stages: quality rules, near duplicates, personal data, mixing and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read by the
next one. All but the last return the columns of documents. ``run`` does this in the folder that the cluster
shares (spark.checkpoint.dir).

Defined results: a null text counts as an empty one, and both fall to the quality rules, as does a text of fewer than 20
words; null and repeated doc_ids are rows like any others, of rows equal in doc_id and text (and of near duplicates) one is kept;
ties between near duplicates go to the least doc_id, then to the least digest of the text; texts of any length go through whole;
empty tables give empty tables; further columns, whatever their names, pass through all stages but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, mixing, pii, quality, simhash
from weftline.llm.common import drop_path, shared_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the boosted trees reject go."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays, that of the least doc_id."""
    return simhash.keep_one_similar(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids (little-endian unsigned 32-bit) of every document, and whether they decode to its text."""
    whole = F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)
    named = docs.select("doc_id", whole.alias("text_sha256"), "text")
    return bpe.tokenise(named, ["doc_id", "text_sha256"]).select(
        "doc_id", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip")
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mix of sources", mix_sources),
    ("tokens", tokens),
]

#: Fingerprints, trees and merges are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if written:
            drop_path(spark, written)
        written = path
    return STAGES[-1][1](spark, docs, sf_dir)
