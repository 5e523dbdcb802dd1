"""Whose turn it is: utterances, interruptions and false interruptions from frames of speech probability.

A frame has a probability of speech, a level, a probability that the utterance is complete, and whether playback begins with
it. What comes out names frames, not samples, so that the machine's state is a dozen small numbers whatever the length of an
utterance; ``audio`` fetches the samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranged
from .folds import ordered_fold
from .ranks import total_before

IDLE, SPEAKING, PENDING = 0, 1, 2
EVENT = "kind string, first long, last long, forced boolean"


@dataclass(frozen=True)
class Limits:
    """Seconds (of frames, pre-roll, gate, barge-in, waiting and resuming), probabilities and the echo floor."""

    frame: float = 0.032
    pre_roll: float = 0.3
    start: float = 0.096
    stop: float = 0.2
    speech: float = 0.5
    dead: float = 0.2
    hold: float = 0.25
    interrupts: float = 0.85
    echo_floor: float = 0.01
    complete: float = 0.5
    longest_wait: float = 2.0
    resume: float = 1.5
    silent: float = 5.0

    def frames(self, seconds: float) -> int:
        return ceil(round(seconds / self.frame, 9))


@dataclass
class State:
    """frame: frames seen; run: loud frames in a row; since: frames since an interruption (-1: none); quiet and asked: frames
    pending, and since the end was last asked for; gate and playback: states of the two machines."""

    frame: int = 0
    mode: int = IDLE
    playing: bool = False
    run: int = 0
    first: int = 0
    since: int = -1
    quiet: int = 0
    asked: int = 0
    gate: int = 0
    playback: int = 0


STATE = ", ".join(f"{f.name} {'boolean' if f.type == 'bool' else 'long'}" for f in fields(State))


class Turns:
    """feed(p, level, complete, begins) -> (kind, first, last, forced): utterance, barge_in, resume or null, the frames (from 0) of
    the utterance so far with its pre-roll, and whether an utterance was closed because the speaker did not go on.

    During playback only loud frames well above it count, held for a while. What stops soon after it interrupted was no
    interruption: playback goes on. Otherwise an utterance begins when the gate opens and ends when, after the gate has closed,
    the end is probable or the pause is too long; speech within the pause continues it."""

    def __init__(self, limits: Limits = Limits(), state: State | None = None) -> None:  # noqa: B008
        self.limits, self.state = limits, state or State()
        ms = lambda s: s * 1000.0
        self.gate = ranged.speech_gate(limits.speech, ms(limits.frame), ms(limits.start), ms(limits.stop))
        self.playback = ranged.barge_in(ms(limits.frame), ms(limits.dead), ms(limits.hold), limits.interrupts)
        self.opened = self._open_gate()

    def _open_gate(self) -> int:
        state = self.gate.start
        while True:
            state, ((change,),) = self.gate.run(state, [[1.0]])
            if change:
                return state

    def _rest(self, playing: bool) -> None:
        s = self.state
        self.state = State(frame=s.frame, playing=playing)

    def _begin(self) -> None:
        s = self.state
        s.mode, s.gate = SPEAKING, self.opened
        s.first = max(0, s.frame - s.run + 1 - self.limits.frames(self.limits.pre_roll))

    def _end(self, kind: str, forced: bool, playing: bool) -> tuple:
        made = (kind, self.state.first, self.state.frame, forced)
        self._rest(playing)
        return made

    def feed(self, p: float | None, level: float | None, complete: float | None, begins: bool | None) -> tuple:
        s = self.state
        if begins and s.mode == IDLE:
            s.playing, s.playback, s.run = True, 0, 0
        made = (self._while_playing if s.playing and s.mode == IDLE else self._while_listening)(p or 0.0, level or 0.0, complete or 0.0)
        self.state.frame += 1
        return made

    def _while_playing(self, p: float, level: float, complete: float) -> tuple:
        s, loud = self.state, p if level >= self.limits.echo_floor else 0.0
        s.playback, ((interrupts,),) = self.playback.run(s.playback, [[loud]])
        s.run = s.run + 1 if loud >= self.limits.interrupts else 0
        if not interrupts:
            return None, None, None, None
        s.run = min(s.run, self.limits.frames(self.limits.hold))
        s.playing, s.since = False, 0
        self._begin()
        return "barge_in", s.first, s.frame, False

    def _while_listening(self, p: float, level: float, complete: float) -> tuple:
        s, none = self.state, (None, None, None, None)
        s.gate, ((change,),) = self.gate.run(s.gate, [[p]])
        s.run = s.run + 1 if p >= self.limits.speech else 0
        if s.since >= 0:
            s.since += 1
            if s.since >= self.limits.frames(self.limits.resume):
                if s.mode != SPEAKING:
                    return self._end("resume", False, True)
                s.since = -1
        if s.mode == IDLE:
            if change == "started":
                self._begin()
            return none
        if s.mode == SPEAKING:
            if change != "stopped":
                return none
            s.mode, s.quiet, s.asked = PENDING, 0, 0
            return self._end("utterance", False, False) if complete >= self.limits.complete else none
        if change == "started":
            s.mode = SPEAKING
            return none
        s.quiet, s.asked = s.quiet + 1, s.asked + 1
        if s.run:  # perhaps going on: the gate will tell
            return none
        if s.quiet >= self.limits.frames(self.limits.longest_wait):
            return self._end("utterance", True, False)
        if s.asked >= self.limits.frames(self.limits.stop):
            s.asked = 0
            return self._end("utterance", False, False) if complete >= self.limits.complete else none
        return none

    def stored(self) -> tuple:
        return tuple(asdict(self.state).values())


def turns(frames: DataFrame, keys: Sequence[str], order: Sequence[str], limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """keys, frame and EVENT of the frames (p, level, complete, begins) with which something happens."""
    numbered = total_before(frames.select(*keys, *order, "p", "level", "complete", "begins"), keys, order, F.lit(1), "frame")
    made = ordered_fold(numbered, keys, ["frame"], ["p", "level", "complete", "begins"], lambda: Turns(limits), EVENT, ["frame"])
    return made.filter("kind is not null")


def audio(events: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, frame, kind and audio (the bytes of all its frames) of every utterance; frames: keys, frame, samples."""
    spans = events.filter("kind = 'utterance'").select(*keys, F.col("frame").alias("at"), "kind", F.explode(F.sequence("first", "last")).alias("frame"))
    pieces = spans.join(frames.select(*keys, "frame", "samples"), [*keys, "frame"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", F.hex("samples").alias("x")))), lambda x: x["x"]), "")
    return pieces.groupBy(*keys, F.col("at")).agg(F.unhex(joined).alias("audio")).withColumnRenamed("at", "frame")


def hops(frames: DataFrame, keys: Sequence[str], order: Sequence[str], samples: str, size: int) -> DataFrame:
    """keys, hop (from 0) and values: samples of all frames of a key in order, cut into hops of one size across the borders of
    frames; an unfinished hop is left out. A frame goes to the hops that it has a share in, so a key may be of any length."""
    length = F.size(samples).cast("long")
    placed = total_before(frames.select(*keys, *order, samples).filter(length > 0), keys, order, length, "before")
    start, end = F.col("before"), F.col("before") + F.size(samples)
    each = placed.select(*keys, "before", samples, F.explode(F.sequence(F.floor(start / size), F.floor((end - 1) / size))).alias("hop"))
    low = F.greatest(F.lit(0), F.col("hop") * size - start)
    high = F.least(F.size(samples).cast("long"), (F.col("hop") + 1) * size - start)
    pieces = each.select(*keys, "hop", "before", F.slice(samples, (low + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("before", "piece"))), lambda x: x["piece"]))
    return pieces.groupBy(*keys, "hop").agg(whole.alias("values")).filter(F.size("values") == size)
