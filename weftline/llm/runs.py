"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov.

A run is a maximal stretch of words that repeats itself: smallest period q, length at least ``LEAST`` and ``TIMES`` q, and no
neighbouring word extends it. ``runs`` finds all of them in a sequence in linear time:

1. the Lempel-Ziv factors: each the longest prefix of the rest that also starts earlier, read off a suffix automaton that
   knows where each state first ends;
2. Main's algorithm, for every border between factors: runs that touch it and end in the factor behind it, from the longest
   common extensions to both sides (Z-functions) of every period; such a run begins at most two lengths of the factor before
   and one of the factor behind ahead of the border;
3. all other runs are strictly inside a factor, and are copied from the factor's earlier occurrence, in the order of starts.

Whole texts are looked at first for stretches that can hold a run, in numpy and over many texts at once: in a run of 24 words
at least 16 neighbouring words recur at the distance of the period, so every run is covered by windows of 16 words that
occur twice in the text. Equal windows have equal hashes; a stretch of windows whose hashes are met twice may hold no run, but
no run is outside one, and words are compared as such inside.

Defined results: a null text has no words; repeated doc_ids and rows each get a row of their own; an empty table gives no
rows; a text of any length is one sequence, held by one task at some 100 bytes a word of its repeating
stretches; other columns are not looked at.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_words import Words, sliced
from .common import SPACES
from .substr import _codes

#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3
WORD_BYTES = ~np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))

Run = tuple[int, int, int]  # start, end, period


class Automaton:
    """The suffix automaton of a sequence of numbers from 0, with the place where each state first ends.

    Nearly all states have one transition; it is kept in two arrays, others in a dictionary of the state."""

    def __init__(self, word: Sequence[int]) -> None:
        self.letter, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        self.link, self.length, self.first = array("i", [-1]), array("i", [0]), array("i", [-1])
        last = 0
        for at, c in enumerate(word):
            last = self._extend(last, at, c)

    def _state(self, length: int, first: int) -> int:
        self.letter.append(-1)
        self.to.append(-1)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def next(self, state: int, c: int) -> int:
        """The state after the letter c, -1 if there is none."""
        if self.letter[state] == c:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(c, -1)

    def _put(self, state: int, c: int, to: int) -> None:
        if self.letter[state] in (-1, c):
            self.letter[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _extend(self, last: int, at: int, c: int) -> int:
        new, p = self._state(at + 1, at), last
        while p != -1 and self.next(p, c) < 0:
            self._put(p, c, new)
            p = self.link[p]
        if p == -1:
            return new
        q = self.next(p, c)
        if self.length[p] + 1 != self.length[q]:
            twin = self._state(self.length[p] + 1, self.first[q])
            self.letter[twin], self.to[twin], self.link[twin] = self.letter[q], self.to[q], self.link[q]
            if q in self.more:
                self.more[twin] = dict(self.more[q])
            while p != -1 and self.next(p, c) == q:
                self._put(p, c, twin)
                p = self.link[p]
            self.link[q] = q = twin
        self.link[new] = q
        return new


def factors(word: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, earlier start or -1) of the Lempel-Ziv factors; occurrences may overlap."""
    found, at, n = Automaton(word), 0, len(word)
    while at < n:
        state, size = 0, 0
        while at + size < n and (to := found.next(state, word[at + size])) > 0 and found.first[to] < at + size:
            state, size = to, size + 1
        yield at, max(1, size), found.first[state] - size + 1 if size else -1
        at += max(1, size)


def extensions(s: Sequence[int]) -> list[int]:
    """The length of the longest common prefix of s and each of its suffixes."""
    n = len(s)
    out, left, right = [n] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def crossing(word: Sequence[int], before: int, border: int, end: int, least: int, times: int) -> Iterator[Run]:
    """Runs that touch the border between the factors word[before:border] and word[border:end], and end at most where the
    second one does. A run may come with a multiple of its period, too."""
    reach = 2 * (border - before) + end - border
    if min(reach, border) + end - border < least:
        return
    low = max(0, border - reach - 1)
    u, t = list(word[border : end + 1]), list(word[low:border])
    n, m = end - border, len(t)
    # Letters that occur nowhere keep the parts apart; a common prefix ends with u's next letter at the latest.
    over_u = extensions(u) if n else []
    back_u, back_t = u[n - 1 :: -1] if n else [], t[::-1]
    t_of_tu = extensions([*back_t, -2, *back_u, *back_t])
    u_of_tu = extensions([*u, -2, *t, *u])
    over_t = extensions(back_t)
    for p in range(1, n + 1):
        ahead, behind = (over_u[p] if p < len(over_u) else 0), t_of_tu[m + 1 + n - p]
        if ahead + behind >= (times - 1) * p and p + ahead <= n and (behind < m or low == 0) and p + ahead + behind >= least:
            yield border - behind, border + p + ahead, p
    for p in range(1, m + 1):
        ahead, behind = u_of_tu[len(u) + 1 + m - p], (over_t[p] if p < m else 0)
        if ahead + behind >= (times - 1) * p and ahead <= n and (p + behind < m or low == 0) and p + ahead + behind >= least:
            yield border - p - behind, border + ahead, p


def runs(letters: Sequence[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, end, smallest period) of all runs of a sequence of numbers from 0, sorted; times is 2 or more."""
    word = [*letters, max(letters, default=0) + 1]  # the last letter ends all runs before it
    parts = list(factors(word))
    smallest: dict[tuple[int, int], int] = {}
    for (before, _, _), (start, size, _) in zip(parts, parts[1:]):
        # Behind the last factor nothing follows, so it gets a letter of its own.
        inside = word if start + size < len(word) else [*word, -1]
        for s, e, p in crossing(inside, before, start, start + size, least, times):
            smallest[s, e] = min(p, smallest.get((s, e), p))
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (s, e), p in sorted(smallest.items()):
        by_start.setdefault(s, []).append((e, p))
    for start, size, earlier in parts:
        if size < least + 2 or not by_start:
            continue
        shift = start - earlier
        for s in range(start + 1, start + size - least):
            copied = [(e + shift, p) for e, p in by_start.get(s - shift, ()) if e + shift < start + size]
            if copied:
                by_start[s] = copied + by_start.get(s, [])
    return sorted((s, e, p) for s, found in by_start.items() for e, p in found)


def stretches(words: Words, window: int) -> Iterator[tuple[int, int, int]]:
    """(row, first word, end) of the maximal stretches that windows occurring twice in a row cover."""
    n = len(words.starts) - window + 1
    if n < 2:
        return
    codes, key = _codes(words.data, words.starts, words.ends, 0), np.zeros(n, np.uint64)
    for j in range(window):
        key += codes[j : j + n] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
    at = np.flatnonzero(words.row[:n] == words.row[window - 1 :])
    key = key[at] ^ (words.row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    twice = np.unique(at[order[np.concatenate([same, same + 1])]])
    if not len(twice):
        return
    new = np.flatnonzero((np.diff(twice) > window) | (np.diff(words.row[twice]) != 0)) + 1
    for first, last in zip(twice[np.concatenate([[0], new])].tolist(), twice[np.concatenate([new - 1, [len(twice) - 1]])].tolist()):
        yield int(words.row[first]), first, last + window


def periodic(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (structs of start, length and period, sorted by start and period), best (the run of the greatest length
    by period; of several the first) and collapsed (the words that stay, joined by one space: all but those of a run
    after its first period) of every row of docs."""
    if times < 2 or least < 2 * times:
        raise ValueError("a run has two periods or more, and at least six words for three periods")
    # Words that recur at the distance q in a run: least - q and (times - 1) q at least.
    window = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    fields = [pa.int64(), pa.list_(run_type), run_type, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in sliced(batch.column(1), WORD_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, words.rows), *_found(words, window, least, times, fields[1:])], names=["doc_id", "runs", "best", "collapsed"])

    made = "doc_id long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, made)


def _found(words: Words, window: int, least: int, times: int, fields: list[pa.DataType]) -> list[pa.Array]:
    text, first_word = words.data.tobytes(), np.searchsorted(words.row, np.arange(words.rows + 1))
    found: dict[int, list[Run]] = {}
    for row, start, end in stretches(words, window):
        if end - start >= least:
            names: dict[bytes, int] = {}
            letters = [names.setdefault(text[i:j], len(names)) for i, j in zip(words.starts[start:end].tolist(), words.ends[start:end].tolist())]
            at = start - int(first_word[row])
            found.setdefault(row, []).extend((at + s, at + e, p) for s, e, p in runs(letters, least, times))
    listed, best, collapsed = [], [], []
    for row in range(words.rows):
        of_row = sorted(found.get(row, ()), key=lambda r: (r[0], r[2]))
        kept = text[words.offsets[row] : words.offsets[row + 1]].split()
        if of_row:
            covered = np.zeros(len(kept) + 1, np.int64)
            for s, e, p in of_row:
                covered[s + p] += 1
                covered[e] -= 1
            kept = [w for w, c in zip(kept, np.cumsum(covered).tolist()) if not c]
        as_struct = [{"start": s, "length": e - s, "period": p} for s, e, p in of_row]
        listed.append(as_struct)
        best.append(min(as_struct, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None))
        collapsed.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
    return [pa.array(values, kind) for values, kind in zip((listed, best, collapsed), fields)]
