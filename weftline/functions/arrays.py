"""Numbers and arrays: robust statistics, masks, windows and affect readings as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rolling baseline: MAD to sigma, floor of sigma, limit of z.
MAD_TO_SIGMA, SIGMA_FLOOR, MAX_Z = 1.4826, 0.05, 6.0
#: Fixed values of the composites of z-scores and of their reading.
AROUSAL = {"rms_mean": 0.30, "rms_p95": 0.15, "f0_median_hz": 0.20, "onset_rate_hz": 0.25, "pause_ratio": -0.10}
VALENCE = {"f0_iqr_hz": 0.6, "pause_ratio": -0.2, "voiced_ratio": 0.2}
DEAD_BAND, CONFIDENCE_FLOOR, WARM_UP, HISTORY = 2.0, 0.45, 5, 50
#: Fixed values of the fusion of two readings: weights, factor on agreement, on disagreement.
LANE_WEIGHTS, AGREE, DISAGREE = (0.6, 0.4), 1.25, 0.4


def median(values: Column) -> Column:
    """Middle of a sorted array, or the mean of the two; null on an empty one."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.try_element_at(s, i.cast("int"))
    return F.when(n % 2 == 1, at((n + 1) / 2)).when(n > 0, (at(n / 2) + at(n / 2 + 1)) / 2)


def mad(values: Column, centre: Column) -> Column:
    return median(F.transform(values, lambda v: F.abs(v - centre)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def robust_z(value: Column, history: Column, absolute_floor: bool = False) -> Column:
    """How far value is from the median of history in robust sigmas; null without history or spread. The floor of
    sigma is a share of the median, or absolute."""
    centre = median(history)
    floor = F.lit(SIGMA_FLOOR) if absolute_floor else F.abs(centre) * SIGMA_FLOOR
    sigma = F.greatest(mad(history, centre) * MAD_TO_SIGMA, floor)
    return F.when(sigma > 0, clamp((value - centre) / sigma, -MAX_Z, MAX_Z))


def composite(z: Column, weights: dict[str, float]) -> Column:
    """Weighted mean over the entries of a map of z-scores that are there, by the absolute weight present."""
    parts = [(F.try_element_at(z, F.lit(k)), w) for k, w in weights.items()]
    total = sum((F.when(v.isNotNull(), abs(w)).otherwise(0.0) for v, w in parts), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(v, F.lit(0.0)) * w for v, w in parts), F.lit(0.0)) / total)


def band(z: Column, dead: float = DEAD_BAND) -> Column:
    return F.when(z >= dead, "higher").when(z <= -dead, "lower").otherwise("usual")


def describe(z: Column, confidence: Column) -> Column:
    """The words for a reading that is sure enough and off the usual, else null."""
    energy = F.when(band(z) == "higher", "more energy than usual").when(band(z) == "lower", "flatter and quieter than usual")
    return F.when(confidence >= CONFIDENCE_FLOOR, F.concat(energy, F.lit(", tone-confidence "), F.when(confidence >= 0.7, "high").otherwise("medium")))


def confidence(n: Column, voiced_ratio: Column, seconds: Column, window_seconds: float = 3.0) -> Column:
    grown = F.least(F.lit(1.0), F.sqrt(n / float(HISTORY)))
    whole = (0.4 + 0.6 * grown) * F.least(F.lit(1.0), voiced_ratio / 0.5) * F.least(F.lit(1.0), seconds / window_seconds)
    return F.when(n < WARM_UP, 0.0).otherwise(clamp(whole, 0.0, 1.0))


def fuse(a: Column, b: Column) -> Column:
    """One reading (arousal_z, valence_z, confidence, events, baseline_n) from two structs, either of which may be
    null or without confidence; null from none."""
    wa, wb = (F.coalesce(x["confidence"], F.lit(0.0)) * w for x, w in zip((a, b), LANE_WEIGHTS))
    total = wa + wb
    mean = lambda f: (a[f] * wa + b[f] * wb) / total
    side = lambda x: F.when(F.abs(x["arousal_z"]) < DEAD_BAND, 0).otherwise(F.signum(x["arousal_z"]))
    raw = total / sum(LANE_WEIGHTS)
    factor = F.when((side(a) == 0) | (side(b) == 0), 1.0).when(side(a) == side(b), AGREE).otherwise(DISAGREE)
    both = F.struct(
        mean("arousal_z").alias("arousal_z"), mean("valence_z").alias("valence_z"), clamp(raw * factor, 0.0, 1.0).alias("confidence"),
        F.array_distinct(F.concat(a["events"], b["events"])).alias("events"), F.least(a["baseline_n"], b["baseline_n"]).alias("baseline_n"),
    )
    one = lambda x: F.struct(*[x[f].alias(f) for f in ("arousal_z", "valence_z", "confidence", "events", "baseline_n")])
    return F.when((wa > 0) & (wb > 0), both).when(wa > 0, one(a)).when(wb > 0, one(b))


def fit_clip(values: Column, length: int, start: Column | None = None) -> Column:
    """An array cut to length from its middle (or from start, counted from 0), or padded with zeros at its end."""
    n = F.size(values)
    at = F.floor((n - length) / 2).cast("int") if start is None else start
    return F.when(n >= length, F.slice(values, at + 1, F.lit(length))).otherwise(F.concat(values, F.array_repeat(F.lit(0.0).cast("float"), F.lit(length) - n)))


def masked(ids: Column, mask: Column, ignore: int = -100) -> Column:
    return F.zip_with(ids, mask, lambda i, m: F.when(m != 0, i).otherwise(F.lit(ignore)))


def padded(ids: Column, length: Column | int, value: int = -100) -> Column:
    n = length if isinstance(length, Column) else F.lit(length)
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(0), n - F.size(ids)).cast("int")))


def without_start(ids: Column, start: int) -> Column:
    return F.when(F.try_element_at(ids, F.lit(1)) == start, F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)


def tail(values: Column, most: int) -> Column:
    """The last ones."""
    return F.when(F.size(values) > most, F.slice(values, -most, most)).otherwise(values)


def rms(values: Column, frame: int) -> Column:
    """Root mean square of each whole frame of an array."""
    frames = F.floor(F.size(values) / frame).cast("int")
    part = lambda i: F.slice(values, i * frame + 1, F.lit(frame))
    mean = lambda i: F.sqrt(F.aggregate(part(i), F.lit(0.0), lambda s, v: s + v.cast("double") * v) / frame)
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), mean)).otherwise(F.array().cast("array<double>"))


def pause_ratio(levels: Column, decibels: float = -35.0) -> Column:
    """Share of frames more than decibels below the loudest."""
    floor = F.array_max(levels) * (10 ** (decibels / 20))
    return F.size(F.filter(levels, lambda v: v < floor)) / F.nullif(F.size(levels), F.lit(0))


def gain(values: Column) -> Column:
    """struct(peak, rms, clipped share) of samples in -1..1."""
    n = F.size(values)
    return F.struct(
        F.array_max(F.transform(values, lambda v: F.abs(v.cast("double")))).alias("peak"),
        F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double") * v) / F.nullif(n, F.lit(0))).alias("rms"),
        (F.size(F.filter(values, lambda v: F.abs(v) >= 0.999)) / F.nullif(n, F.lit(0))).alias("clipped"),
    )


def suppression_db(before: Column, after: Column) -> Column:
    return 20 * F.log10(before / after)


def blended_targets(label: Column, intensity: Column, labels: tuple[str, ...] = ("happy", "angry", "sad", "relaxed", "surprised")) -> Column:
    """A map from each expressive label to its weight: one at its intensity, the others 0."""
    return F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*[F.when(label == x, clamp(intensity, 0.0, 1.0)).otherwise(0.0) for x in labels]))


def smoothing(dt: float, tau: float) -> float:
    return 1.0 - math.exp(-dt / max(tau, 1e-6))
