"""Closed validators: each gives a reason or a verdict and never repairs its input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answers to a question, phrases that a recogniser makes up from noise, and limits.
YES = ("yes", "yeah", "yep", "yup", "sure", "go", "go ahead", "do it", "please", "please do", "confirm", "affirmative", "haan", "haan ji", "haanji", "theek hai", "thik hai", "kar do", "karo")
NO = (
    "no", "nope", "nah", "don't", "dont", "stop", "cancel", "never mind", "nevermind", "forget it", "wait", "hold on", "negative", "nahi", "nahin", "mat karo", "rehne do", "ruko", "nahi ji",
)
MADE_UP = ("thank you", "thanks for watching", "you", "bye", "okay", "ok", "uh", "um", "ha")
MOST_WORDS, NO_SPEECH, LOG_PROB = 4, 0.4, -1.0
#: What a payload must not contain, the one shape it may have, and the names it may call.
FORBIDDEN = ("os.", "io.", "eval", "repl", "plugin", "exec", "spawn", "exit", "load", "dofile", "require", "package", "debug.", "getfenv", "setfenv", "rawset", "metatable")
PAYLOAD = r"""(?i)^hl\.dsp\.([a-z_.]+)\(\{\s*(?:[a-z_]+\s*=\s*(?:\d+|true|false|"[A-Za-z0-9:_\-. ]*")\s*,?\s*)*+\}\)$"""
DISPATCHERS = ("focus",)


def egress_reason(payload: Column) -> Column:
    """Why a payload is refused: empty, forbidden, shape or dispatcher; null for one that passes."""
    low = F.lower(payload)
    bad = F.lit(False)
    for word in FORBIDDEN:
        bad = bad | (F.instr(low, word) > 0)
    trimmed = F.trim(payload)
    return (
        F.when(F.coalesce(trimmed, F.lit("")) == "", "empty").when(bad, "forbidden").when(~trimmed.rlike(PAYLOAD), "shape")
        .when(~F.regexp_extract(trimmed, PAYLOAD, 1).isin(*DISPATCHERS), "dispatcher")
    )


def plain_answer(transcript: Column) -> Column:
    kept = F.regexp_replace(F.lower(transcript), r"[^\p{L}\p{N}\s']", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def answer(transcript: Column, no_speech: Column, log_prob: Column) -> Column:
    """yes, no or ambiguous: the closed lists decide, unless the recogniser was unsure or more than a few words came."""
    said = plain_answer(F.coalesce(transcript, F.lit("")))
    unsure = (said == "") | said.isin(*MADE_UP) | (no_speech > NO_SPEECH) | (log_prob < LOG_PROB) | (F.size(F.split(said, " ")) > MOST_WORDS)
    return F.when(unsure, "ambiguous").when(said.isin(*YES), "yes").when(said.isin(*NO), "no").otherwise("ambiguous")


def decision(voice: Column, click: Column) -> Column:
    """A click wins over a voice; neither in time is a timeout."""
    return F.coalesce(click, voice, F.lit("timeout"))


def heard(text: Column, worst_no_speech: Column, worst_log_prob: Column) -> Column:
    """A recognised text, or empty where its worst segment is too unsure or it is a phrase made up from noise."""
    bare = F.lower(F.regexp_replace(text, r"^[.,!? ]+|[.,!? ]+$", ""))
    return F.when((worst_no_speech > NO_SPEECH) | (worst_log_prob < LOG_PROB) | bare.isin(*MADE_UP), "").otherwise(F.trim(text))


def tracked_recording(path: Column) -> Column:
    """Whether a path under version control is a recording of a voice."""
    return path.rlike(r"(?i)^(data|recordings|evals)/.*\.(wav|flac|mp3|ogg)$")


def fetch_status(files: Column, bytes_: Column, expected_gb: Column, marked: Column, access: Column) -> Column:
    """already, needs access, no-data, too-small (under a quarter of what was recorded) or done, in this order."""
    return (
        F.when(marked, "already").when(access.isin("request-form", "paid", "unavailable"), F.concat(F.lit("needs-"), access)).when(F.coalesce(files, F.lit(0)) == 0, "no-data")
        .when(bytes_ < expected_gb * 1e9 * 0.25, "too-small").otherwise("done")
    )
