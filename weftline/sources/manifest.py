"""The manifest of datasets: a small TOML table, validated, as a DataFrame."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import CLOSED_FLAGS, VERDICTS

VERSION = 1
#: What a dataset is for, flags of licences, ways of access.
TARGETS = (
    "ser_lane_b", "emotion_deep", "hindi_stt", "hindi_tts", "hindi_emotion_text", "hinglish_llm", "stt_indian_english", "stt_english", "tts_voice", "persona_lora", "wakeword_speaker_noise", "endpointing",
)
FLAGS = ("permissive", "NC", "ND", "SA", "research-only", "request-required", "gated", "unclear")
ACCESS = ("direct", "hf-login", "hf-gated-approval", "request-form", "paid", "unavailable")
SCHEMA = (
    "name string, target string, priority int, hf_id string, url string, license string, flags array<string>, access string, size_gb double, hours double, "
    "weights_publishable string, note string, sha256 string, allow array<string>, position int"
)
DEFAULTS = {"hf_id": "", "url": "", "hours": 0.0, "note": "", "sha256": "", "allow": []}


def problems(d: dict) -> list[str]:
    """What is wrong with one dataset, in words; an empty list if nothing is."""
    flags, out = set(d.get("flags", ())), []
    unknown = set(d) - {c.split()[0] for c in SCHEMA.split(", ")}
    rules = [
        (bool(unknown), f"unknown fields {sorted(unknown)}"),
        (not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", d.get("name", "")), "name is no safe folder name"),
        (d.get("target") not in TARGETS, "unknown target"),
        (d.get("priority") not in (1, 2, 3), "priority must be 1, 2 or 3"),
        (not flags <= set(FLAGS), "unknown flags"),
        (d.get("access") not in ACCESS, "unknown access"),
        (d.get("weights_publishable") not in VERDICTS, "unknown verdict"),
        (d.get("size_gb", -1) < 0 or d.get("hours", 0) < 0, "sizes must not be negative"),
        (bool(d.get("hf_id")) == bool(d.get("url")), "exactly one of hf_id and url"),
        (bool(d.get("allow")) and not d.get("hf_id"), "allow patterns need hf_id"),
        (bool(d.get("sha256")) and bool(d.get("hf_id")), "sha256 is for url downloads"),
        (d.get("weights_publishable") == "yes" and bool(flags & {*CLOSED_FLAGS, "unclear"}), "flags forbid publishing"),
    ]
    return out + [text for broken, text in rules if broken]


def parse(spark: SparkSession, toml: str) -> DataFrame:
    """The manifest of a TOML text; raises ValueError with all that is wrong."""
    whole = tomllib.loads(toml)
    rows = [DEFAULTS | d | {"position": i} for i, d in enumerate(whole.get("dataset", []))]
    wrong = [f"{r.get('name')}: {p}" for r in rows for p in problems({k: v for k, v in r.items() if k != "position"})]
    if whole.get("schema_version") != VERSION:
        wrong.append("unknown schema version")
    for what, key in (("name", lambda r: r["name"]), ("source", lambda r: (r["hf_id"] or r["url"]).lower().rstrip("/"))):
        seen = [key(r) for r in rows if r.get("name")]
        wrong += [f"{what} {v} occurs twice" for v in sorted({v for v in seen if seen.count(v) > 1})]
    if wrong:
        raise ValueError("; ".join(wrong))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(float(r[n]) if n in ("size_gb", "hours") else r[n] for n in names) for r in rows], SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark, "\n".join(r[0] for r in spark.read.text(path).collect()))


def select(manifest: DataFrame, most: int = 1, target: str | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """A list of names wins over priority and target; the order is that of priority, then of the file."""
    if only is not None:
        chosen = manifest.filter(F.col("name").isin(*only))
    else:
        chosen = manifest.filter(F.col("priority") <= most)
        chosen = chosen.filter(F.col("target") == target) if target else chosen
    return chosen.orderBy("priority", "position")


def totals(manifest: DataFrame) -> DataFrame:
    """Datasets, GB and hours by target, with every target."""
    every = manifest.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, TARGETS))).alias("target"))
    sums = manifest.groupBy("target").agg(F.count("*").alias("n"), F.round(F.sum("size_gb"), 1).alias("size_gb"), F.round(F.sum("hours"), 1).alias("hours"))
    return every.join(sums, "target", "left").na.fill(0)
