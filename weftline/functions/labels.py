"""Emotion labels: aliases, positions on the circumplex, tags, kinds of speech, and voice directions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (valence, arousal) of each canonical label.
CIRCUMPLEX = {
    "neutral": (0.0, 0.0), "calm": (0.3, -0.5), "relaxed": (0.4, -0.4), "bored": (-0.3, -0.6), "tired": (-0.2, -0.7), "sad": (-0.6, -0.4), "depressed": (-0.7, -0.5),
    "disgust": (-0.6, 0.2), "contempt": (-0.5, 0.1), "fear": (-0.7, 0.7), "anger": (-0.6, 0.8), "frustrated": (-0.5, 0.4), "surprise": (0.1, 0.8), "excited": (0.6, 0.8),
    "happy": (0.8, 0.5), "amused": (0.7, 0.4), "affection": (0.7, 0.0), "grateful": (0.6, 0.1), "content": (0.6, -0.3), "pleasure": (0.7, 0.2), "hopeful": (0.5, 0.2),
    "interested": (0.4, 0.3), "awe": (0.4, 0.5), "confused": (-0.2, 0.3), "doubtful": (-0.3, 0.1), "longing": (-0.3, -0.2), "disappointed": (-0.5, -0.2),
    "ashamed": (-0.5, -0.1), "embarrassed": (-0.4, 0.3), "distressed": (-0.7, 0.6),
}
#: Other spellings; empty where a label has no place and its row is dropped.
ALIASES = {
    "ang": "anger", "dis": "disgust", "fea": "fear", "hap": "happy", "neu": "neutral", "sad": "sad", "angry": "anger", "happiness": "happy", "joy": "happy", "sadness": "sad",
    "fearful": "fear", "afraid": "fear", "disgusted": "disgust", "surprised": "surprise", "surprise": "surprise", "ps": "surprise", "pleasant_surprise": "surprise",
    "pleasantsurprise": "surprise", "calm": "calm", "sleepiness": "tired", "sleepy": "tired", "amused": "amused", "amusement": "amused", "excitement": "excited", "exc": "excited",
    "fru": "frustrated", "frustration": "frustrated", "xxx": "", "other": "", "unknown": "", "none": "", "astonishment": "surprise", "bitterness": "contempt", "confusion": "confused",
    "contentment": "content", "disappointment": "disappointed", "distress": "distressed", "doubt": "doubtful", "elation": "excited", "embarrassment": "embarrassed", "fatigue": "tired",
    "helplessness": "sad", "hope": "hopeful", "impatience_and_irritability": "frustrated", "infatuation": "happy", "interest": "interested", "jealousy_&_envy": "frustrated",
    "malevolence": "contempt", "pain": "distressed", "pride": "happy", "relief": "content", "shame": "ashamed", "sourness": "disgust", "teasing": "amused", "thankfulness": "grateful",
    "triumph": "excited", "arousal": "", "authenticity": "", "concentration": "", "contemplation": "", "emotional_numbness": "", "intoxication": "", "sexual_lust": "",
}
#: Beginnings of corpus names by kind of speech, looked at in this order.
SPEECH_KINDS = {
    "acted": ("crema-d", "ravdess", "tess", "savee", "esd", "emov-db", "jl-corpus", "subesco", "rasa"),
    "natural": ("msp-podcast", "iemocap", "meld", "msp-conversation"),
    "synthetic": ("emonet-voice-bench",),
}
#: Names by index, tags of names, and names that have no tag but spoil none.
FINE_NAMES = (
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion", "curiosity", "desire", "disappointment", "disapproval", "disgust", "embarrassment",
    "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism", "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
)
FINE_TAGS = {
    "admiration": "happy", "amusement": "happy", "excitement": "happy", "gratitude": "happy", "joy": "happy", "love": "happy", "optimism": "happy", "pride": "happy", "anger": "angry",
    "annoyance": "angry", "disappointment": "sad", "grief": "sad", "remorse": "sad", "sadness": "sad", "relief": "relaxed", "surprise": "surprised", "neutral": "neutral",
}
FINE_IGNORED = ("approval", "disapproval", "caring", "confusion", "curiosity", "desire", "realization")
PLAIN_TAGS = {"joy": "happy", "anger": "angry", "sadness": "sad", "surprise": "surprised"}


def lookup(table: dict, key: Column) -> Column:
    """The value of key in a small fixed table, or null."""
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def canonical(label: Column) -> Column:
    """The canonical name of a label, or empty where it has none (the row is dropped, never neutral)."""
    key = F.translate(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), " -", "__")
    name = F.coalesce(lookup(ALIASES, key), key)
    return F.when(name.isin(*CIRCUMPLEX), name).otherwise("")


def circumplex(label: Column) -> Column:
    """struct(valence, arousal) of a label, or null."""
    name = canonical(label)
    valence, arousal = (lookup({k: v[i] for k, v in CIRCUMPLEX.items()}, name) for i in (0, 1))
    return F.when(name != "", F.struct(valence.alias("valence"), arousal.alias("arousal")))


def speech_kind(corpus: Column) -> Column:
    """acted, natural or synthetic by the beginning of the name; null when not recorded."""
    key, out = F.lower(F.trim(corpus)), F.lit(None).cast("string")
    for kind, names in reversed(SPEECH_KINDS.items()):
        starts = F.lit(False)
        for name in names:
            starts = starts | key.startswith(name)
        out = F.when(starts, kind).otherwise(out)
    return out


def acted(corpus: Column) -> Column:
    kind = speech_kind(corpus)
    return F.when(kind == "acted", True).when(kind == "natural", False)


def one_tag(names: Column, table: dict[str, str], ignored: Sequence[str] = ()) -> Column:
    """The one tag that a list of names has in common. No name at all: neutral; a name unknown, only names that
    are ignored, or more than one tag: null."""
    tags = F.array_distinct(F.filter(F.transform(names, lambda n: lookup(table, n)), lambda t: t.isNotNull()))
    known = F.forall(names, lambda n: n.isin(*table, *ignored))
    return F.when(F.size(names) == 0, "neutral").when(known & (F.size(tags) == 1), F.try_element_at(tags, F.lit(1)))


def names_of(ids: Column, names: Sequence[str] = FINE_NAMES) -> Column:
    """Names of indices; null where one is out of range."""
    found = F.transform(ids, lambda i: F.try_element_at(F.array(*map(F.lit, names)), (F.when(i >= 0, i) + 1).cast("int")))
    return F.when(F.forall(found, lambda n: n.isNotNull()), found)


def strength(intensity: Column) -> Column:
    return F.when(intensity < 0.35, "slightly").when(intensity < 0.70, "").otherwise("clearly")


def exaggeration(label: Column, intensity: Column, floor: float = 0.25, ceiling: float = 0.8) -> Column:
    return F.when(label == "neutral", floor).otherwise(floor + (ceiling - floor) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), intensity)))
