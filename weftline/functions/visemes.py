"""Mouth shapes of phonemes, and their timeline."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Phonemes by mouth shape, punctuation (the mouth is closed), symbols that are no sound.
SHAPES = {
    "aa": "ɑ a æ ʌ ɐ ɒ ɑː aɪ aʊ ɚ ɜ ɜː ə h I W ᵊ ʔ",
    "ih": "ɪ i ɨ j s z t d n l r ɹ θ ð ʃ ʒ tʃ dʒ ʧ ʤ ʦ ʣ ʨ ʥ ɾ T ᵻ",
    "ou": "u ʊ uː w f v",
    "ee": "e ɛ eɪ ɛə A",
    "oh": "o ɔ oʊ ɔː ɔɪ m b p ŋ ɡ g k O Y Q",
}
PUNCTUATION = " .,!?;:'\"-—…“”()"
SILENT_SYMBOLS = "↓→↗↘"
OPEN = "aa"

_SHAPE_OF = {p: shape for shape, phonemes in SHAPES.items() for p in phonemes.split()}


def modifies(symbol: str) -> bool:
    """Whether a symbol only changes the sound beside it."""
    return symbol not in _SHAPE_OF and (symbol in SILENT_SYMBOLS or unicodedata.category(symbol) in ("Mn", "Lm", "Sk"))


def shape(phoneme: str, previous: str = "") -> str:
    """The shape of a phoneme: closed for punctuation, the previous one for a bare modifier, open if not known."""
    p = phoneme.strip()
    if not p or p in PUNCTUATION:
        return ""
    if p in _SHAPE_OF:
        return _SHAPE_OF[p]
    sounds = [c for c in p if not modifies(c)]
    return _SHAPE_OF.get("".join(sounds)) or _SHAPE_OF.get(sounds[0], OPEN) if sounds else previous


def timeline(phonemes: str, durations: list[float], start: float = 0.0) -> list[dict]:
    """(start, shape, seconds) of the mouth; equal shapes that follow each other are one."""
    out: list[dict] = []
    for p, seconds in zip(phonemes, durations):
        now = shape(p, out[-1]["shape"] if out else "")
        if out and out[-1]["shape"] == now:
            out[-1]["seconds"] += seconds
        else:
            out.append({"start": start, "shape": now, "seconds": seconds})
        start += seconds
    return out


TIMELINE = "array<struct<start:double,shape:string,seconds:double>>"


def timelines(df: DataFrame, key: str, phonemes: str, durations: str) -> DataFrame:
    """key and timeline of rows with phonemes (string) and durations (array of double)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.float64()), ("shape", pa.string()), ("seconds", pa.float64())]))
        for batch in batches:
            got = [timeline(p or "", d or []) for p, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], names=[key, "timeline"])

    return df.select(key, phonemes, durations).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, timeline {TIMELINE}")
