"""Ordered folds of one key by all tasks.

A fold asks for the rows of a key one after the other, so ``folds.ordered_fold`` gives a key to one task. Here rows are dealt by
ranges of (key, order), and a key may go on over any number of ranges:

1. every range is summed up as a function: from the state in which its first key enters to the state in which it leaves. For a
   machine of finitely many states that is one state for each, followed all at once until they meet; other machines say how
   they sum up (``Gaps``, ``Lengths``). The keys that begin inside the range need no entry state;
2. the functions are applied one after the other, one step a range, which gives each range its entry state;
3. every range runs the machine over its rows from there.

The driver sees two states and one function a range, whatever the rows.

A machine here has a ``start``, ``run`` (state and columns to state and rows made), and for its functions ``identity``,
``then`` (function and columns to function), ``told`` (what goes to the driver) and ``apply`` (that and a state to a state)."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Hashable, Iterator, Sequence
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import cut

SLICE = 8192
#: A pure function of a state and a symbol, which gives the next state and what is made of the row.
Rule = Callable[[Hashable, Hashable], tuple[Hashable, tuple]]


class Finite:
    """A machine of finitely many states: those that the rule reaches from the start by the symbols. symbol turns the inputs of a
    row into one of them."""

    def __init__(self, start: Hashable, symbols: Sequence[Hashable], rule: Rule, symbol: Callable[..., Hashable], most: int = 10_000) -> None:
        self.symbol, self.place = symbol, {s: i for i, s in enumerate(symbols)}
        number, waiting, self.next, self.made = {start: 0}, [start], [], []
        while waiting:
            reached = [rule(waiting[0], s) for s in symbols]
            waiting = waiting[1:]
            for state, _ in reached:
                if state not in number:
                    number[state] = len(number)
                    waiting.append(state)
                    if len(number) > most:
                        raise ValueError(f"more than {most} states: the rule does not belong to a finite machine")
            self.next.append([number[state] for state, _ in reached])
            self.made.append([made for _, made in reached])
        self.start = 0

    def symbols(self, inputs: Sequence[list]) -> list[int]:
        return [self.place[self.symbol(*row)] for row in zip(*inputs)]

    def run(self, state: int, inputs: Sequence[list]) -> tuple[int, list[tuple]]:
        out = []
        for s in self.symbols(inputs):
            out.append(self.made[state][s])
            state = self.next[state][s]
        return state, out

    def identity(self) -> list[int]:
        return list(range(len(self.next)))

    def then(self, function: list[int], inputs: Sequence[list]) -> list[int]:
        """function, and then the rows: all exit states at once, each different one followed once."""
        now = {s: s for s in function}
        for s in self.symbols(inputs):
            if len(now) == 1:
                break
            now = {origin: self.next[state][s] for origin, state in now.items()}
            first: dict[int, int] = {}
            merged = {origin: first.setdefault(state, origin) for origin, state in now.items()}
            if len(first) < len(now):
                function = [merged[x] for x in function]
                now = {origin: state for state, origin in first.items()}
        if len(now) == 1:
            (origin,) = now
            now = {origin: self.run(origin, inputs)[0]}
        return [now[x] for x in function]

    def told(self, function: list[int]) -> list[int]:
        return function

    def apply(self, function: list[int], state: int) -> int:
        return function[state]


class Gaps:
    """Times that come at least ``seconds`` after the last one that passed. feed(at) makes (passes,); the state is the last time
    that passed.

    How a range is left depends on the entry state by the first time that passes only, which is one of those less than
    ``seconds`` after the first time or the next one. From each of them a chain of passing times goes on; chains whose last
    times are passed by one and the same time go on alike from there."""

    start = None

    def __init__(self, seconds: float) -> None:
        self.seconds = seconds

    def run(self, state: float | None, inputs: Sequence[list]) -> tuple[float | None, list[tuple]]:
        out = []
        for at in inputs[0]:
            passes = state is None or at - state >= self.seconds
            state = at if passes else state
            out.append((passes,))
        return state, out

    def identity(self) -> dict:
        return {"first": None, "open": True, "chains": deque()}

    def then(self, function: dict, inputs: Sequence[list]) -> dict:
        chains = function["chains"]  # (last time, beginnings), last times rising
        for at in inputs[0]:
            begun: list[float] = []
            while chains and at - chains[0][0] >= self.seconds:
                more = chains.popleft()[1]
                begun, more = (begun, more) if len(begun) >= len(more) else (more, begun)
                begun += more
            if function["open"]:
                function["first"] = at if function["first"] is None else function["first"]
                function["open"] = at - function["first"] < self.seconds
                begun.append(at)
            if begun:
                chains.append((at, begun))
        return function

    def told(self, function: dict) -> list[tuple[float, float]]:
        """(beginning, last time) by beginning; of neighbours that end alike the last, as what lets an earlier one pass lets it, too."""
        every = sorted((s, end) for end, begun in function["chains"] for s in begun)
        return [x for x, after in zip(every, [*every[1:], (None, None)]) if x[1] != after[1]]

    def apply(self, function: list, state: float | None) -> float | None:
        return next((end for s, end in function if state is None or s - state >= self.seconds), state)


class Lengths:
    """Length of the run of rows that count, and when it began. feed(counts, at) makes (length, since)."""

    start = (0, None)

    def run(self, state: tuple, inputs: Sequence[list]) -> tuple[tuple, list[tuple]]:
        (length, since), out = state, []
        for counts, at in zip(*inputs):
            since = (since if length else at) if counts else None
            length = length + 1 if counts else 0
            out.append((length, since))
        return (length, since), out

    def identity(self) -> tuple:
        return True, self.start

    def then(self, function: tuple, inputs: Sequence[list]) -> tuple:
        """Whether all rows count, so that the run before goes on, and the run of the range alone."""
        return function[0] and all(inputs[0]), self.run(function[1], inputs)[0]

    def told(self, function: tuple) -> tuple:
        return function

    def apply(self, function: tuple, state: tuple) -> tuple:
        whole, (length, since) = function
        return (state[0] + length, state[1] if state[0] else since) if whole else (length, since)


class Changes:
    """Number of the run of equal values that a row is in, from 1. feed(value) makes (run,)."""

    start = (0, None)

    def run(self, state: tuple, inputs: Sequence[list]) -> tuple[tuple, list[tuple]]:
        (number, last), out = state, []
        for value in inputs[0]:
            number += number == 0 or value != last
            last = value
            out.append((number,))
        return (number, last), out

    def identity(self) -> tuple:
        return None, self.start

    def then(self, function: tuple, inputs: Sequence[list]) -> tuple:
        first, own = function
        return inputs[0][0] if own[0] == 0 else first, self.run(own, inputs)[0]

    def told(self, function: tuple) -> tuple:
        return function

    def apply(self, function: tuple, state: tuple) -> tuple:
        first, (number, last) = function
        return (state[0] + number - (state[0] > 0 and first == state[1]), last) if number else state


class Streaks:
    """Length of the run of successes (as a negative number: of failures), and whether the place is in use: taken up by ``promote``
    successes in a row, left by ``demote`` failures in a row. feed(ok) makes (streak, used).

    A range is summed up as its first run, which goes on where the entry state has left off, and the rest, which knows of
    the entry only whether the place is in use."""

    start = (0, False)

    def __init__(self, promote: int = 3, demote: int = 1) -> None:
        self.promote, self.demote = promote, demote

    def _after(self, state: tuple, ok: bool, n: int) -> tuple:
        """n rows that are all ok, or none."""
        streak, used = state
        if ok:
            streak = n + (streak if streak > 0 else 0)
            return streak, used or streak >= self.promote
        streak = (streak if streak < 0 else 0) - n
        return streak, used and -streak < self.demote

    def run(self, state: tuple, inputs: Sequence[list]) -> tuple[tuple, list[tuple]]:
        out = []
        for ok in inputs[0]:
            state = self._after(state, ok, 1)
            out.append(state)
        return state, out

    def identity(self) -> tuple:
        return None, 0, None

    def then(self, function: tuple, inputs: Sequence[list]) -> tuple:
        side, n, rest = function
        for ok in map(bool, inputs[0]):
            if rest is None and (n == 0 or ok == side):
                side, n = ok, n + 1
            else:
                rest = [self._after(s, ok, 1) for s in (rest or [(0, False), (0, True)])]
        return side, n, rest

    def told(self, function: tuple) -> tuple:
        return function

    def apply(self, function: tuple, state: tuple) -> tuple:
        side, n, rest = function
        state = self._after(state, side, n) if n else state
        return state if rest is None else rest[state[1]]


def _at_least(bound: float, value: float | None) -> bool:
    return value is not None and value >= bound


BANDS = ("lower", "usual", "higher")


def _band(dead: float, z: float | None) -> str | None:
    return None if z is None else BANDS[1 + (z >= dead) - (z <= -dead)]


def speech_gate(threshold: float = 0.5, frame_ms: float = 32.0, start_ms: float = 96.0, stop_ms: float = 200.0) -> Finite:
    """Speech starts with enough frames in a row at or above a threshold and stops with more frames in a row below it.
    feed(p) makes (change,): started, stopped or null. The state: speaking or not, and the frames in a row against it."""
    needed = {False: -(-start_ms // frame_ms), True: -(-stop_ms // frame_ms)}  # frames that end silence, or speech

    def rule(state: tuple, loud: bool) -> tuple:
        speaking, against = state
        if loud == speaking:
            return (speaking, 0), (None,)
        if against + 1 >= needed[speaking]:
            return (loud, 0), ("started" if loud else "stopped",)
        return (speaking, against + 1), (None,)

    return Finite((False, 0), (False, True), rule, partial(_at_least, threshold))


def barge_in(frame_ms: float = 32.0, dead_ms: float = 200.0, hold_ms: float = 250.0, p: float = 0.85) -> Finite:
    """Whether speech over playback interrupts it: loud for hold_ms in a row, counted once playback has lasted dead_ms.
    feed(p) makes (interrupts,). The state: frames still dead, frames still to hold."""
    dead, hold = int(-(-dead_ms // frame_ms)), int(-(-hold_ms // frame_ms))

    def rule(state: tuple, loud: bool) -> tuple:
        waits, holds = state
        waits = max(0, waits - 1)
        holds = max(0, holds - 1) if loud and not waits else hold
        return (waits, holds), (holds == 0,)

    return Finite((dead, hold), (False, True), rule, partial(_at_least, p))


def band_hysteresis(dead_band: float = 2.0, window: int = 3, agree: int = 2) -> Finite:
    """A band that moves to where most of the last readings are, or right away while there are too few to agree. feed(z) makes
    (candidate, band, settled); a null reading leaves all as it is."""

    def rule(state: tuple, candidate: str | None) -> tuple:
        recent, band = state
        if candidate is not None:
            recent = (*recent, candidate)[-window:]
            band = candidate if len(recent) < agree or recent.count(candidate) >= agree else band
        return (recent, band), (candidate, band, candidate in (None, band))

    return Finite(((), "usual"), (None, *BANDS), rule, partial(_band, dead_band))


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """The named columns of df by ranges of (keys, order), one a partition, sorted inside. Written once, as ranges come from a
    sample that another run need not repeat."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*dict.fromkeys([*keys, *order, *columns]))
    return cut(rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_range", F.spark_partition_id()))


def _pieces(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """(key, columns) of the rows of each key, in slices."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            got = batch.slice(at, SLICE).to_pydict()
            of_row = list(zip(*(got[k] for k in keys))) if keys else [()] * len(got["_range"])
            start = 0
            while start < len(of_row):
                end = bisect_left(range(len(of_row)), True, lo=start, key=lambda i: of_row[i] != of_row[start])  # noqa: B023
                yield of_row[start], {c: values[start:end] for c, values in got.items()}
                start = end


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], machine: Any, made: str, carried: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """What ``folds.ordered_fold`` gives, for a machine of this module: keys, carried and made of every row of df. The columns
    of order are plain columns that tell the rows of a key apart. Keys, order, inputs and carried are all that is dealt."""
    kept = list(dict.fromkeys([*keys, *carried]))
    rows = dealt(df, keys, order, [*inputs, *carried], parts)
    told = _summaries(rows, keys, inputs, machine)
    entry = entries(told, machine)
    extra = StructType.fromDDL(made)
    out = StructType([df.schema[c] for c in kept] + extra.fields)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, first = None, None, True
        for key, got in _pieces(batches, keys):
            if first:
                last, first = key, False
                state = entry.get(got["_range"][0], machine.start)
            elif key != last:
                last, state = key, machine.start
            state, new = machine.run(state, [got[c] for c in inputs])
            columns = [got[c] for c in kept] + [list(c) for c in zip(*new)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, out)


def _summaries(rows: DataFrame, keys: Sequence[str], inputs: Sequence[str], machine: Any) -> list[tuple]:
    """(range, first key, last key, function of the first key, state of the last key if it is another) of every range, in
    their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, head, last, function, state = None, None, None, machine.identity(), None
        for key, got in _pieces(batches, keys):
            if number is None:
                number, head, last = got["_range"][0], key, key
            if key == head:
                function = machine.then(function, [got[c] for c in inputs])
                continue
            if key != last:
                last, state = key, machine.start
            state = machine.run(state, [got[c] for c in inputs])[0]
        if number is not None:
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "told": pa.array([pickle.dumps((head, last, machine.told(function), state))], pa.binary())})

    got = rows.mapInArrow(run, "number int, told binary").collect()  # one row a range
    return sorted(((r["number"], *pickle.loads(r["told"])) for r in got), key=lambda r: r[0])


def entries(told: Sequence[tuple], machine: Any) -> dict[int, Any]:
    """The state in which the first key of each range enters it, where that is not the start."""
    out, key, state = {}, None, None
    for number, head, last, function, inside in told:
        entry = state if key == head else machine.start
        if key == head:
            out[number] = entry
        key, state = last, machine.apply(function, entry) if last == head else inside
    return out
