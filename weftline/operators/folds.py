"""Ordered folds: state machines over the rows of a key in order.

A fold whose next state depends on its own last decision has no window expression. ``ordered_fold`` deals rows
by key, sorts inside the partitions, and streams them through a machine that is made anew for each key; it
holds one machine and one slice of rows, so a key of any number of rows passes through, in one task. ``ranged`` gives the
rows of a key to all tasks, for machines that can be summed up over a range. The same machines run under Structured Streaming (weftline.streaming)."""

from __future__ import annotations

import math
import re
from bisect import insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import ranged

SLICE = 2048
_TAG = re.compile(r"^<e:(happy|angry|sad|relaxed|surprised|neutral):([0-9])>\s*", re.IGNORECASE)


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], inputs: Sequence[str], machine: Callable, made: str, carried: Sequence[str] = ()) -> DataFrame:
    """keys and carried of every row of df, and the columns made: what machine().feed(*inputs) returns for it (a
    tuple), the rows of a key in order."""
    kept = list(dict.fromkeys([*keys, *carried]))
    fields = StructType([df.schema[c] for c in kept])
    extra = StructType.fromDDL(made)
    out = StructType(fields.fields + extra.fields)
    schema = to_arrow_schema(out)
    names = list(dict.fromkeys([*kept, *inputs]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                got = batch.slice(at, SLICE).to_pydict()
                new = []
                for key, row in zip(zip(*(got[k] for k in keys)), zip(*(got[c] for c in inputs))):
                    if state is None or key != last:
                        last, state = key, machine()
                    new.append(state.feed(*row))
                columns = [got[c] for c in kept] + [list(c) for c in zip(*new)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*names).mapInArrow(run, out)


class DriftingBaseline:
    """Robust z-scores of a value against those before it (the last ``window``), which start anew after ``runs`` extreme ones in a
    row. feed(value) -> (z or None, reset).

    A value is extreme only against a history of ``warm_up`` values or more. The history is kept twice, as it came and
    sorted, so that a median is a look-up and not a sort."""

    def __init__(self, window: int = 50, warm_up: int = 5, extreme: float = 4.0, runs: int = 8) -> None:
        self.window, self.warm_up, self.extreme, self.needed = window, warm_up, extreme, runs
        self.past: list[float] = []
        self.ranked: list[float] = []
        self.in_a_row = 0

    def z(self, value: float) -> float | None:
        n = len(self.ranked)
        if n == 0:
            return None
        centre = (self.ranked[(n - 1) // 2] + self.ranked[n // 2]) / 2
        spread = sorted(abs(p - centre) for p in self.ranked)
        scale = max(1.4826 * (spread[(n - 1) // 2] + spread[n // 2]) / 2, 0.05 * abs(centre))
        return min(6.0, max(-6.0, (value - centre) / scale)) if scale > 0 else None

    def feed(self, value: float | None) -> tuple[float | None, bool]:
        if value is None:
            return None, False
        z = self.z(value)
        if len(self.past) >= self.warm_up:
            self.in_a_row = (self.in_a_row + 1) * (z is not None and abs(z) >= self.extreme)
        drifted = self.in_a_row >= self.needed
        kept = [] if drifted else self.past[-(self.window - 1) :] if self.window > 1 else []
        if len(kept) < len(self.past):
            self.in_a_row = 0 if drifted else self.in_a_row
            self.past, self.ranked = kept, sorted(kept)
        self.past.append(value)
        insort(self.ranked, value)
        return z, drifted


class Fed:
    """A machine of ``ranged`` that is fed row by row."""

    def __init__(self, machine: object) -> None:
        self.machine, self.state = machine, machine.start

    def feed(self, *row: object) -> tuple:
        self.state, (made,) = self.machine.run(self.state, [[x] for x in row])
        return made


class BandHysteresis(Fed):
    """feed(z) -> (candidate, band, settled), see ``ranged.band_hysteresis``."""

    def __init__(self, dead_band: float = 2.0, window: int = 3, agree: int = 2) -> None:
        super().__init__(ranged.band_hysteresis(dead_band, window, agree))


class RateLimit:
    """At most ``most`` admitted events in any ``seconds``; refused ones do not count. feed(at) -> (admitted,)."""

    def __init__(self, most: int = 6, seconds: float = 60.0) -> None:
        self.most, self.seconds, self.past = most, seconds, deque()

    def feed(self, at: float) -> tuple[bool]:
        while self.past and at - self.past[0] >= self.seconds:
            self.past.popleft()
        admitted = len(self.past) < self.most
        if admitted:
            self.past.append(at)
        return (admitted,)


class Refractory(Fed):
    """feed(at) -> (passes,), see ``ranged.Gaps``."""

    def __init__(self, seconds: float = 2.0) -> None:
        super().__init__(ranged.Gaps(seconds))


class SpeechGate(Fed):
    """feed(p) -> (change,), see ``ranged.speech_gate``."""

    def __init__(self, threshold: float = 0.5, frame_ms: float = 32.0, start_ms: float = 96.0, stop_ms: float = 200.0) -> None:
        super().__init__(ranged.speech_gate(threshold, frame_ms, start_ms, stop_ms))
        self.speaking = False

    def feed(self, p: float) -> tuple[str | None]:
        made = super().feed(p)
        self.speaking = made[0] == "started" or (self.speaking and made[0] is None)
        return made


class Listener:
    """Segments frames into utterances: opened and closed by a SpeechGate, or cut at the longest length.

    feed(p) -> (event, frames): utterance or forced with its number of frames, else nothing."""

    def __init__(self, most_ms: float = 30_000.0, frame_ms: float = 32.0) -> None:
        self.gate, self.most, self.frame, self.frames = SpeechGate(frame_ms=frame_ms), most_ms, frame_ms, 0

    def feed(self, p: float) -> tuple[str | None, int | None]:
        change = self.gate.feed(p)[0]
        self.frames += 1 if self.gate.speaking or change == "stopped" else 0
        event = "utterance" if change == "stopped" else "forced" if self.frames * self.frame >= self.most else None
        if event is None:
            return None, None
        length, self.frames = self.frames, 0
        return event, length


class BargeIn(Fed):
    """feed(p) -> (interrupts,), see ``ranged.barge_in``."""

    def __init__(self, frame_ms: float = 32.0, dead_ms: float = 200.0, hold_ms: float = 250.0, p: float = 0.85) -> None:
        super().__init__(ranged.barge_in(frame_ms, dead_ms, hold_ms, p))


class Streak(Fed):
    """feed(ok) -> (streak, used), see ``ranged.Streaks``."""

    def __init__(self, promote: int = 3, demote: int = 1) -> None:
        super().__init__(ranged.Streaks(promote, demote))


class RunLength(Fed):
    """feed(counts, at) -> (length, since), see ``ranged.Lengths``."""

    def __init__(self) -> None:
        super().__init__(ranged.Lengths())


class GreedyCap:
    """Admits what still fits a budget and skips what does not, on and on. feed(amount) -> (admitted,)."""

    def __init__(self, budget: float) -> None:
        self.budget, self.spent = budget, 0.0

    def feed(self, amount: float | None) -> tuple[bool]:
        admitted = amount is not None and self.spent + amount <= self.budget
        self.spent += amount if admitted else 0.0
        return (admitted,)


class Blender:
    """Weights of expressions on their way to a target: the named one at its intensity, all others at nothing.
    feed(label, intensity, seconds) -> (weights,): a map.

    All are one vector. A step of time covers 1 - exp(-seconds / tau) of the way, tau being shorter upwards; what is below a
    floor is nothing, and a sum above a bound is scaled down to it. Surprise has a target that fades by itself once
    it has been held for a while."""

    LABELS = ("happy", "angry", "sad", "relaxed", "surprised")

    def __init__(self, rise: float = 0.12, fall: float = 0.30, hold: float = 0.9, decay: float = 0.6, most: float = 1.0, least: float = 0.01) -> None:
        self.taus, self.fade, self.bounds = (fall, rise), (hold, decay), (least, most)
        self.now, self.held = np.zeros(len(self.LABELS)), 0.0

    def feed(self, label: str, intensity: float, seconds: float) -> tuple[dict[str, float]]:
        if seconds > 0:
            target = np.array([name == label for name in self.LABELS]) * np.clip(intensity, 0.0, 1.0)
            self.held = (self.held + seconds) * (target[-1] > 0)
            target[-1] *= math.exp(min(0.0, (self.fade[0] - self.held) / self.fade[1]))
            tau = np.choose(target > self.now, self.taus)
            moved = self.now + (target - self.now) * -np.expm1(-seconds / tau)
            moved[moved < self.bounds[0]] = 0.0
            self.now = moved * min(1.0, self.bounds[1] / max(moved.sum(), self.bounds[1]))
        return (dict(zip(self.LABELS, self.now.tolist())),)


class Chunker:
    """Speakable pieces of a text that arrives in parts: the first at a clause of two words or a sentence, then by
    sentence. feed(text, end) -> (pieces,); the result does not depend on how the text was cut."""

    STOPS, PAUSES = ".!?", ",;:—–"

    def __init__(self, clause_words: int = 2) -> None:
        self.words, self.rest, self.started = clause_words, "", False

    def _cut(self) -> int | None:
        for i, c in enumerate(self.rest):
            ends = i + 1 == len(self.rest) or self.rest[i + 1].isspace()
            if ends and (c in self.STOPS or not self.started and c in self.PAUSES and len(self.rest[: i + 1].split()) >= self.words):
                at = i + 1
                while at < len(self.rest) and self.rest[at].isspace():
                    at += 1
                # What may still grow at the end is not cut yet: more text could follow without a space.
                return at if at > i + 1 else None
        return None

    def feed(self, text: str | None, end: bool = False) -> tuple[list[str]]:
        self.rest += text or ""
        out = []
        while (at := self._cut()) is not None:
            piece, self.rest = self.rest[:at].strip(), self.rest[at:]
            if piece:
                out.append(piece)
                self.started = True
        if end and self.rest.strip():
            out.append(self.rest.strip())
            self.rest, self.started = "", True
        return (out,)


class TagParser:
    """The tag at the start of a reply that arrives in parts, and what is spoken of it. Without a tag after
    ``patience`` characters (or at the end) the reply is neutral. feed(text, end) -> (label, intensity, spoken):
    label and intensity once, on the part that settles them.

    What is spoken is a function of all that has arrived: everything behind the tag and the white space after it. A part
    speaks what that has grown by."""

    def __init__(self, patience: int = 32) -> None:
        self.patience, self.reply, self.spoken, self.settled = patience, "", 0, False

    def feed(self, text: str | None, end: bool = False) -> tuple[str | None, float | None, str]:
        self.reply += text or ""
        tag = _TAG.match(self.reply)
        first = not self.settled and (tag is not None or end or len(self.reply) >= self.patience)
        self.settled = self.settled or first
        if not self.settled:
            return None, None, ""
        behind = self.reply[tag.end() if tag else 0 :]
        new, self.spoken = behind[self.spoken :], len(behind)
        if not first:
            return None, None, new
        return (tag[1].lower(), int(tag[2]) / 9, new) if tag else ("neutral", 0.5, new)


class Gate:
    """Decides on attempts to call a tool, in this order: the source may ask, the place may act, the tool's limit and
    the limit of all with side effects are not used up, and it was confirmed where that is needed.

    feed(tool, at, source_ok, reach_ok, side_effect, needs_confirm, confirmed) -> (outcome,)."""

    def __init__(self, per_tool: int = 6, in_all: int = 30, seconds: float = 60.0) -> None:
        self.per_tool, self.seconds, self.tools, self.all = per_tool, seconds, {}, RateLimit(in_all, seconds)

    def feed(self, tool: str, at: float, source_ok: bool, reach_ok: bool, side_effect: bool, needs_confirm: bool, confirmed: bool) -> tuple[str]:
        if not source_ok:
            return ("source_refused",)
        if not reach_ok:
            return ("reach_refused",)
        if not self.tools.setdefault(tool, RateLimit(self.per_tool, self.seconds)).feed(at)[0] or (side_effect and not self.all.feed(at)[0]):
            return ("rate_limited",)
        return ("denied",) if needs_confirm and not confirmed else ("allowed",)


class TwoPhase:
    """Values are staged and join the history only on commit, the last one of each; discard drops it.
    feed(action, value) -> (history size, mean)."""

    def __init__(self) -> None:
        self.staged, self.past = None, []

    def feed(self, action: str, value: float | None) -> tuple[int, float | None]:
        if action == "stage":
            self.staged = value
        else:
            if action == "commit" and self.staged is not None:
                self.past.append(self.staged)
            self.staged = None
        return len(self.past), sum(self.past) / len(self.past) if self.past else None
