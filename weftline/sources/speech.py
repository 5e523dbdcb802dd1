"""Indices of speech corpora: metadata columns only, every unusable row with its reason, audio decoded late."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators.corpus import skip_reasons
from ..operators.splits import speaker
from . import scans
from .tables import shards

#: Reasons for a row to be left out, in the order in which they are looked at.
REASONS = ("missing_column", "no_duration", "empty_text", "annotator_tag", "too_long", "too_short")
#: The reason of a shard that cannot be read at all.
UNUSABLE = "unusable_shard"
LONGEST, SHORTEST = 30.0, 0.3


@dataclass(frozen=True)
class Corpus:
    """Which columns of a corpus hold what; duration may be missing, then it is read from the audio header."""

    name: str
    text: str
    speaker: str
    duration: str | None = None
    audio: str = "audio"
    fallbacks: tuple[str, ...] = ()
    held_out: tuple[str, ...] = ()


#: The columns of each corpus.
CORPORA = {
    "kathbath": Corpus("kathbath", "text", "speaker_id", "duration", "audio_filepath", held_out=("valid",)),
    "indicvoices": Corpus("indicvoices", "verbatim", "speaker_id", "duration", "audio_filepath", ("text", "normalized")),
    "mls-english": Corpus("mls-english", "transcript", "speaker_id", "audio_duration", "audio", held_out=("dev", "test")),
    "english-dialects-uk": Corpus("english-dialects-uk", "text", "speaker_id", None, "audio"),
}


def wav_seconds(blob: bytes | None) -> float | None:
    """Seconds of a WAV file from its header."""
    try:
        with wave.open(io.BytesIO(blob or b"")) as w:
            return w.getnframes() / w.getframerate() if w.getframerate() else None
    except (wave.Error, EOFError, struct.error):
        return None


def wav_samples(blob: bytes | None) -> np.ndarray | None:
    """Mono samples in -1..1 of a 16-bit WAV file, channels averaged; None if it is none."""
    try:
        with wave.open(io.BytesIO(blob or b"")) as w:
            if w.getsampwidth() != 2:
                return None
            raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
            return raw.reshape(-1, w.getnchannels()).mean(axis=1)
    except (wave.Error, EOFError, struct.error, ValueError):
        return None


def _durations(df: DataFrame, audio: str) -> DataFrame:
    """df with seconds from the headers of its audio column (struct with bytes), and without that column."""
    kept = [c for c in df.columns if c != audio]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(batch.schema.names.index("_bytes")).to_pylist()
            rest = [batch.column(batch.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([wav_seconds(b) for b in blobs], pa.float64())], names=[*kept, "seconds"])

    slim = df.select(*kept, F.col(f"{audio}.bytes").alias("_bytes"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != audio)
    return slim.mapInArrow(run, f"{shape}, seconds double")


def index(spark: SparkSession, corpus: Corpus, root: str, shortest: float = SHORTEST, longest: float = LONGEST) -> DataFrame:
    """corpus, shard, row_index, speaker, seconds, text, declared_split and skip_reason (null: usable) of every row.
    Only the named columns are read, in one scan for all shards that agree in them; a shard that lacks one gives rows with the
    reason missing_column, a shard whose footer cannot be read one row with the reason unusable_shard (rows of one that
    breaks off behind its footer are counted by ``scans.unread``)."""
    relevant = {corpus.text, *corpus.fallbacks, corpus.speaker, corpus.audio, *([corpus.duration] if corpus.duration else [])}

    def shaped(raw: DataFrame, have: set[str]) -> DataFrame:
        col = lambda c: F.col(c) if c in have else F.lit(None)
        texts = [F.col(c).cast("string") for c in (corpus.text, *corpus.fallbacks) if c in have]
        named = [col(corpus.speaker).cast("string").alias("_speaker"), (tx.first_text(texts) if texts else F.lit("")).alias("text")]
        place = [F.lit(corpus.name).alias("corpus"), F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row_index")]
        if corpus.duration:
            part = raw.select(*place, *named, col(corpus.duration).cast("double").alias("seconds"), F.lit(corpus.duration in have).alias("_timed"))
        elif corpus.audio in have:
            part = _durations(raw.select(*place, *named, F.lit(True).alias("_timed"), F.col(corpus.audio)), corpus.audio)
        else:
            part = raw.select(*place, *named, F.lit(None).cast("double").alias("seconds"), F.lit(False).alias("_timed"))
        return part.select("corpus", "shard", "row_index", "_speaker", "text", "seconds", "_timed")

    out, told = scans.scan(spark, shards(spark, root), relevant, shaped)
    broken = told.filter("reason is not null").select(
        F.lit(corpus.name).alias("corpus"), F.element_at(F.split("path", "/"), -1).alias("shard"), *[F.lit(None).cast(t).alias(c) for c, t in (("row_index", "long"), ("speaker", "string"), ("seconds", "double"), ("text", "string"))],
        F.lit(None).cast("string").alias("declared_split"), F.lit(UNUSABLE).alias("skip_reason"),
    )
    if out is None:
        return broken
    rules = [
        ("missing_column", F.col("_speaker").isNull() | ~F.col("_timed")), ("no_duration", F.col("seconds").isNull()), ("empty_text", F.col("text") == ""),
        ("annotator_tag", tx.annotator_tag(F.col("text"))), ("too_long", F.col("seconds") > longest), ("too_short", F.col("seconds") < shortest),
    ]
    split = F.split_part(F.regexp_replace("shard", r"\.parquet$", ""), F.lit("-"), F.lit(1))
    found = skip_reasons(out, rules).select("corpus", "shard", "row_index", speaker(F.col("corpus"), F.col("_speaker")).alias("speaker"), "seconds", "text", split.alias("declared_split"), "skip_reason")
    return found.unionByName(broken)


def clips(spark: SparkSession, root: str, chosen: DataFrame, audio: str = "audio") -> DataFrame:
    """shard, row_index and samples of chosen rows (shard, row_index): the audio column is read for these only."""
    raw = spark.read.option("recursiveFileLookup", True).parquet(root)
    rows = raw.select(F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row_index"), F.col(f"{audio}.bytes").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.to_pydict()
            samples = [wav_samples(b) for b in got["bytes"]]
            yield pa.RecordBatch.from_arrays([pa.array(got["shard"]), pa.array(got["row_index"], pa.int64()), pa.array([None if s is None else s.tolist() for s in samples], pa.list_(pa.float32()))], names=["shard", "row_index", "samples"])

    return rows.join(chosen.select("shard", "row_index").distinct(), ["shard", "row_index"], "left_semi").mapInArrow(run, "shard string, row_index long, samples array<float>")


def held_out(corpora: Sequence[Corpus], fraction: float = 0.10) -> Column:
    """Rows that could be in eval: the splits that a corpus declares, or a slice of its speakers where it declares none."""
    out, edge = F.lit(False), round(fraction * 100)
    for c in corpora:
        own = F.col("declared_split").isin(*c.held_out) if c.held_out else tx.hash_bucket(F.col("speaker"), 100) < edge
        out = out | ((F.col("corpus") == c.name) & own)
    return out


def content_names(rows: DataFrame, blob: str = "bytes", suffix: str = ".wav") -> DataFrame:
    """rows with a file name from the hash of the content, so that the same clip has the same name on every run."""
    return rows.withColumn("file", F.concat(F.sha2(blob, 256), F.lit(suffix)))


def style_names(rows: DataFrame, style: str, order: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Rows of the allowed styles with a running number in each style, for file names."""
    number = F.row_number().over(Window.partitionBy(style).orderBy(*order)) - 1
    return rows.filter(F.col(style).isin(*allowed)).withColumn("file", F.concat_ws("_", style, number.cast("string")))


def packed_frames(rows: DataFrame, key: str, samples: str) -> DataFrame:
    """key and frame: an unsigned 32-bit id and the samples as 32-bit floats, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = [struct.pack("<I", k) + np.asarray(v or [], "<f4").tobytes() for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frames, pa.binary())], names=[key, "frame"])

    return rows.select(F.col(key).cast("long").alias(key), samples).mapInArrow(run, f"`{key}` long, frame binary")
