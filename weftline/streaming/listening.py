"""The turns of ``operators.listen`` on a stream, with the audio of utterances.

Each key keeps its machine as a value of typed fields and the frames it may still need (those of the open utterance, or else the
pre-roll) as a list; a timer in event time closes a key that has gone silent and drops its state. Events do not
depend on how frames fall into micro-batches, as long as the frames of a key come in order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.listen import IDLE, STATE, Limits, State, Turns

OUT = "key string, frame long, kind string, first long, last long, forced boolean, audio binary"


class _Listening(StatefulProcessor):
    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", STATE)
        self.frames = handle.getListState("frames", "frame long, samples binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        stored = self.machine.get() if self.machine.exists() else None
        turns = Turns(self.limits, State(*stored) if stored is not None else None)
        held = [tuple(r) for r in self.frames.get()] if self.frames.exists() else []
        last = None
        for row in sorted(rows, key=lambda r: r["at"]):
            frame, last = turns.state.frame, row["at"]
            held.append((frame, bytes(row["samples"] or b"")))
            kind, first, end, forced = turns.feed(row["p"], row["level"], row["complete"], row["begins"])
            if kind is not None:
                sound = b"".join(s for f, s in held if first <= f <= end) if kind == "utterance" else None
                yield Row(key=key[0], frame=frame, kind=kind, first=first, last=end, forced=forced, audio=sound)
            held = self._needed(turns, held)
        self.machine.update(turns.stored())
        self._keep(held)
        if last is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((last.timestamp() + self.limits.silent) * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """The key has gone silent: an open utterance is closed, and nothing is kept."""
        if self.machine.exists():
            state = State(*self.machine.get())
            if state.mode != IDLE:
                held = [tuple(r) for r in self.frames.get()] if self.frames.exists() else []
                yield Row(key=key[0], frame=state.frame - 1, kind="utterance", first=state.first, last=state.frame - 1, forced=True, audio=b"".join(bytes(s) for f, s in held if f >= state.first))
        self.machine.clear()
        self.frames.clear()

    def _needed(self, turns: Turns, held: list[tuple]) -> list[tuple]:
        s, limits = turns.state, self.limits
        # A run that will have proved to be speech began at most this long ago.
        behind = limits.frames(limits.pre_roll) + max(limits.frames(limits.start), limits.frames(limits.hold)) + 1
        oldest = s.first if s.mode != IDLE else s.frame - behind
        at = next((i for i, (f, _) in enumerate(held) if f >= oldest), len(held))
        return held[at:] if at else held

    def _keep(self, held: list[tuple]) -> None:
        if held:
            self.frames.put(held)
        else:
            self.frames.clear()


def turns(stream: DataFrame, delay: str = "10 seconds", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """OUT of a stream of frames (key, at, samples, p, level, complete, begins)."""
    marked = stream.withWatermark("at", delay)
    return marked.groupBy("key").transformWithState(_Listening(limits), OUT, "append", "EventTime")
