"""Emotional speech corpora that say all in their file names: one row an utterance.

Columns: path, valence, arousal, corpus, speaker (named within the corpus), label (canonical), raw_label.
Labels without a place on the circumplex drop out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb
from .tables import media_names

#: How names are built, and what their codes mean.
NAMES = {
    "crema-d": r"^([0-9]{4})_[A-Z]{3}_([A-Z]{3})_[A-Z]{2}\.wav$",
    "ravdess": r"^[0-9]{2}-[0-9]{2}-([0-9]{2})-[0-9]{2}-[0-9]{2}-[0-9]{2}-([0-9]{2})\.wav$",
    "tess": r"(?i)^(OAF|YAF)_[a-z]+_([a-z_]+)\.wav$",
    "savee": r"^([A-Z]{2})_([a-z]{1,2})[0-9]+\.wav$",
    "rasa": r"^(male|female)_([A-Z]+)_[0-9]+\.wav$",
}
RAVDESS = {"01": "neutral", "02": "calm", "03": "happy", "04": "sad", "05": "anger", "06": "fear", "07": "disgust", "08": "surprise"}
SAVEE = {"a": "anger", "d": "disgust", "f": "fear", "h": "happy", "n": "neutral", "sa": "sad", "su": "surprise"}


def utterances(rows: DataFrame, corpus: str, speaker: Column, raw: Column) -> DataFrame:
    place = lb.circumplex(raw)
    made = rows.select(
        "path", place["valence"].alias("valence"), place["arousal"].alias("arousal"), F.lit(corpus).alias("corpus"), F.concat(F.lit(f"{corpus}:"), speaker).alias("speaker"),
        lb.canonical(raw).alias("label"), raw.alias("raw_label"),
    )
    return made.filter("valence is not null")


def named(corpus: str, speaker_group: int = 1, label_group: int = 2, codes: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A reader of a corpus whose file names hold speaker and label."""

    def read(spark: SparkSession, root: str) -> DataFrame:
        files = media_names(spark, root).filter(F.col("name").rlike(NAMES[corpus]))
        raw = F.regexp_extract("name", NAMES[corpus], label_group)
        label = F.coalesce(lb.lookup(codes, raw), F.lit("")) if codes else raw
        return utterances(files, corpus, F.regexp_extract("name", NAMES[corpus], speaker_group), label)

    return read


def agreed_bench(spark: SparkSession, root: str) -> DataFrame:
    """A bench with an index of raters' scores: rows that every rater heard, whose clip is there."""
    index = spark.read.csv(f"{root}/extracted/index.csv", header=True, schema="file string, clip string, category string, intensities string")
    scores = F.transform(F.filter(F.split(F.coalesce("intensities", F.lit("")), ";"), lambda s: s != ""), lambda s: s.try_cast("int"))
    kept = index.withColumn("scores", scores).filter(F.expr("size(scores) > 0 and forall(scores, s -> coalesce(s, 0) >= 1) and clip <> ''"))
    files = media_names(spark, f"{root}/extracted").select("path", F.regexp_extract("path", r"extracted/(.*)$", 1).alias("file"))
    return utterances(kept.join(files, "file"), "emonet-voice-bench", F.col("clip"), F.coalesce("category", F.lit("")))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "crema-d": named("crema-d"),
    "ravdess": named("ravdess", 2, 1, RAVDESS),
    "tess": named("tess"),
    "savee": named("savee", codes=SAVEE),
    "rasa": named("rasa"),
    "emonet-voice-bench": agreed_bench,
}


def load(spark: SparkSession, datasets: str, names: list[str] | None = None) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [READERS[n](spark, f"{datasets}/{n}") for n in (names or READERS)])


def summary(rows: DataFrame) -> DataFrame:
    """Counts by corpus, label and kind of speech, and in all, in one pass; kinds that do not occur are not listed."""
    kinds = rows.withColumn("kind", F.coalesce(lb.speech_kind(F.col("corpus")), F.lit("unrecorded")))
    sets = [["corpus"], ["label"], ["kind"], []]
    return kinds.groupingSets([[F.col(c) for c in s] for s in sets], "corpus", "label", "kind").agg(F.count("*").alias("n"), F.count_distinct("speaker").alias("speakers"))
