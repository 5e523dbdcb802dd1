"""Log analytics: waterfalls of stages, headline latencies, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import numbered

#: Stages of a turn in order; outcomes that close an attempt.
STAGES = ("endpoint", "stt_start", "stt_done", "emotion_resolved", "tts_first_chunk", "sink_first_sent", "sink_played", "turn_done")
OUTCOMES = ("succeeded", "failed", "denied", "rate_limited")


def stage_steps(df: DataFrame, key: str, stage: str = "stage", at: str = "t", stages: Sequence[str] = STAGES) -> DataFrame:
    """Milliseconds between each two stages of a turn that follow each other among those stamped."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col(stage))
    w = Window.partitionBy(key).orderBy("_place")
    rows = df.withColumn("_place", place).filter("_place > 0")
    steps = rows.withColumns({"step": F.concat(F.col(stage), F.lit("->"), F.lead(stage).over(w)), "end_stage": F.lead(stage).over(w), "ms": (F.lead(at).over(w) - F.col(at)) * 1000.0})
    return steps.filter("ms is not null").select(key, "step", "end_stage", "ms")


def headline(timeline: Column, start: str = "endpoint", end: str = "sink_played") -> Column:
    """From the end of speech to the first sound, in ms; null where either was not stamped."""
    return (F.try_element_at(timeline, F.lit(end)) - F.try_element_at(timeline, F.lit(start))) * 1000.0


def logged_latency(latency: Column, timeline: Column) -> Column:
    """The logged value, or that of the timeline where none (or 0) was logged."""
    return F.coalesce(F.nullif(latency, F.lit(0.0)), headline(timeline))


def of_tier(df: DataFrame, tier: str, profile: str) -> DataFrame:
    """Rows of one tier and profile; a row that does not say matches."""
    return df.filter((F.coalesce("tier", F.lit(tier)) == tier) & (F.coalesce("profile", F.lit(profile)) == profile))


def unfinished(df: DataFrame, keys: Sequence[str] = ("tool", "turn", "call"), attempt: str = "attempted") -> DataFrame:
    """Attempts without an outcome of their own."""
    closed = df.filter(F.col("event").isin(*OUTCOMES)).select(*keys).distinct()
    return df.filter(F.col("event") == attempt).join(closed, list(keys), "left_anti")


def numbered_calls(df: DataFrame, turn: str, order: Sequence[str]) -> DataFrame:
    return df.withColumn("call", F.row_number().over(Window.partitionBy(turn).orderBy(*order)))


def rotated(df: DataFrame, kind: str, order: Sequence[str], lines: Sequence[str]) -> DataFrame:
    """The line for each row: the n-th occurrence of a kind takes the n-th line, around and around."""
    counted = numbered(df, [kind], order, "_n")
    return counted.withColumn("line", F.element_at(F.array(*map(F.lit, lines)), (F.col("_n") % len(lines) + 1).cast("int"))).drop("_n")
