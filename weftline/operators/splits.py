"""Splits by speaker that leak nobody, samples and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .budgets import capped


def speaker(corpus: Column, name: Column) -> Column:
    """Speakers are named within their corpus: the same number in two corpora is two people."""
    return F.concat_ws(":", corpus, name)


def speaker_side(key: Column, val: int = 15, test: int = 30, buckets: int = 100) -> Column:
    bucket = tx.hash_bucket(key, buckets)
    return F.when(bucket < val, "val").when(bucket < test, "test").otherwise("train")


def seeded_sample(df: DataFrame, most: int, identity: Sequence[str], seed: int = 0) -> DataFrame:
    """At most ``most`` rows, the first in the order of a seeded hash: the same on every run and cluster."""
    return df.withColumn("_o", F.sha2(F.concat_ws("|", F.lit(str(seed)), *identity), 256)).orderBy("_o", *identity).limit(most).drop("_o")


def sample_per_file(rows: DataFrame, files: int, each: int, seed: int = 0) -> DataFrame:
    """Some rows of some files: the first files, and in each the first rows, in the order of a seeded hash. rows has
    file_path and row_index; what is ranked are places."""
    order = lambda *c: F.sha2(F.concat_ws("|", F.lit(str(seed)), *c), 256)
    chosen = rows.select("file_path").distinct().orderBy(order("file_path")).limit(files)
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy(order("file_path", "row_index")))
    places = rows.join(F.broadcast(chosen), "file_path").select("file_path", "row_index", rank.alias("_r")).filter(F.col("_r") <= each)
    return rows.join(places.drop("_r"), ["file_path", "row_index"], "left_semi")


def plan_split(rows: DataFrame, held_out: Column, identity: Sequence[str], seed: int = 0, eval_limit: int | None = None, hours: float | None = None) -> DataFrame:
    """identity, speaker, seconds and split (eval, train, leak, over, left) of every row.

    Speakers of all rows that could be in eval are struck from train before eval is sampled, so a speaker whose
    rows were not sampled does not come back; train is then cut to a budget of hours."""
    marked = rows.withColumn("_held", F.coalesce(held_out, F.lit(False)))
    speakers = marked.filter("_held").select(F.col("speaker").alias("_speaker")).distinct()
    sided = marked.join(speakers, F.col("speaker") == F.col("_speaker"), "left")
    side = F.when(F.col("_held"), "eval").when(F.col("_speaker").isNotNull(), "leak").otherwise("train")
    slim = sided.select(*identity, "speaker", "seconds", side.alias("split"))
    if eval_limit is not None:
        taken = seeded_sample(slim.filter("split = 'eval'"), eval_limit, identity, seed).select(*identity, F.lit(True).alias("_t"))
        slim = slim.join(taken, list(identity), "left").withColumn("split", F.when((F.col("split") == "eval") & F.col("_t").isNull(), "left").otherwise(F.col("split"))).drop("_t")
    if hours is not None:
        fits = capped(slim.filter("split = 'train'"), "seconds", hours * 3600.0, (), seed, identity).select(*identity, F.lit(True).alias("_f"))
        slim = slim.join(fits, list(identity), "left").withColumn("split", F.when((F.col("split") == "train") & F.col("_f").isNull(), "over").otherwise(F.col("split"))).drop("_f")
    return slim


def leaks(split: DataFrame) -> DataFrame:
    """Speakers on both sides: an empty table, or the split is wrong."""
    side = lambda name: split.filter(F.col("split") == name).select("speaker")
    return side("train").intersect(side("eval").union(side("left")))


def summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum("seconds") / 3600, 4).alias("hours"), F.count_distinct("speaker").alias("speakers"))
