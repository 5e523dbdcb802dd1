"""Substring deduplication with a log-structured fingerprint index.

A window of ``WIDTH`` words is a copy if its word sequence also starts earlier. Of all windows of ``GRAM`` words
inside it, each long window selects the one (or ones) of least hash; equal long windows select equal
grams at equal places, so a long window can have a copy only if its selected grams occur again. The index has
two levels of sorted immutable runs, tables bucketed and sorted by their hashes, so that runs are merge-joined
without a shuffle:

* gram runs: the selected grams of a batch (about a seventh of all positions), how often each occurs, and the place
  of the first;
* window runs: two independent 64-bit hashes (of words under two seeds) of every long window that selects a gram which occurs again.

A new batch is joined with the history as it comes. Its gram run is merge-joined with the runs before: grams that
occur once in it and in no other run are unique, and so is every long window that selects one. A gram that
occurred only once in all of history and now comes again is opened: the history document that holds it, and no other,
is read again for the long windows around it, which have not been hashed before. The other windows of the batch are
hashed and verified against each other, the opened windows and, by merge join, the window runs; the least place of
a sequence that history has not owns it, and every other window is a copy. Then both runs are added; beyond
``MAX_RUNS`` runs a level is compacted into one.

No shuffle holds all windows, hot passages are combined before each shuffle, and what goes back to a document is a list no
longer than the document. Between batches the files of shuffles that no one needs any more are given back.

Defined results: a null text has no words; documents of fewer than WIDTH words keep all; a null doc_id comes
after all others, any other value of a long is an id like any; rows of one doc_id and different texts are one
document as to order (earlier start first, then the lesser hash of the text), but are marked each by itself; rows
equal in doc_id and text keep the same words and do not remove each other; an empty table gives no rows; texts of any
length are taken whole; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, SMALL, cut, drop_path, release, shared_path, small_batches, utf8

#: With more batches than runs a level, the last batch meets runs that have been compacted.
WIDTH, GRAM, MAX_RUNS, BATCHES = 20, 8, 2, 4

_rng = np.random.default_rng(20)
_ODD = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1, 2**63, GRAM + 2 * WIDTH)]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _finish(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


#: By seed: a factor of each byte (0 for white space, so that it adds nothing), an odd factor of each place in a word.
_BYTES = _rng.integers(1, 2**63, (2, 256)).astype(np.uint64)
_BYTES[:, np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", np.uint8)] = 0
_PLACES = _rng.integers(1, 2**63, (2, 64)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _BYTES[:, None, :] * _PLACES[:, :, None]
WORDS_AT_ONCE = 1 << 16
#: Bytes of text looked at in one go; a longer text is looked at by itself.
AT_ONCE = 1 << 18


def _edges(text: np.ndarray, borders: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes; no word goes over a border, where a text begins or ends."""
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = (text != 32) & (text - np.uint8(9) > 4)
    starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    if borders is not None:
        starts[borders], ends[borders] = inside[borders + 1], inside[borders]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def _codes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each word: the sum of its bytes' factors times those of their places; longer words by XXH64."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(starts), WORDS_AT_ONCE):
        part = slice(at, at + WORDS_AT_ONCE)
        size = np.minimum(ends[part] - starts[part], 64).astype(np.uint8)
        # The longest first, so that the words that have a byte at some place are the first so many.
        order = np.argsort(64 - size, kind="stable")
        first, total = starts[part][order], np.zeros(len(order), np.uint64)
        reach = len(order) - np.cumsum(np.bincount(size, minlength=65))
        for place in range(size.max()):
            n = reach[place]
            total[:n] += _FACTORS[seed, place].take(text.take(first[:n] + place))
        out[at + order] = total
    for i in np.flatnonzero(ends - starts > 64).tolist():
        out[i] = xxh64_intdigest(text[starts[i] : ends[i]].tobytes(), seed)
    return _finish(out)


def _hashes(words: np.ndarray, width: int, odd: list[np.uint64]) -> np.ndarray:
    """A hash of each window of width words."""
    out = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        out += words[j : j + len(out)] * odd[j]
    return _finish(out)


def _slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or largest) of each width neighbouring values, by doubling."""
    pick, span = np.minimum if least else np.maximum, 1
    while span * 2 <= width:
        values, span = pick(values[: len(values) - span], values[span:]), span * 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


class Marks:
    """The words of some texts, one text behind the other, and the grams that begin at them: hash, whether selected, and the least
    hash in each long window. Words, grams and windows are numbered over all the texts, and none is of two texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        self.starts, self.ends = _edges(data, offsets)
        self.base = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.base)
        self.row = np.repeat(np.arange(self.rows), self.count)
        self.long = bool((self.count >= WIDTH).any())
        if self.long:
            self.codes = _codes(data, self.starts, self.ends, 0)
            self.gram = _hashes(self.codes, GRAM, _ODD)
            inside, none = WIDTH - GRAM + 1, np.uint64(0)
            self.whole = self.row[: len(self.row) - WIDTH + 1] == self.row[WIDTH - 1 :]
            self.least = _slide(self.gram, inside, True)
            padded = np.concatenate([np.zeros(inside - 1, np.uint64), np.where(self.whole, self.least, none), np.zeros(inside - 1, np.uint64)])
            held = (self.count >= WIDTH)[self.row[: len(self.gram)]] & (self.row[: len(self.gram)] == self.row[GRAM - 1 :])
            self.selected = (_slide(padded, inside, False) == self.gram) & held

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two hashes of the long windows at starts; the words of each have codes of their own."""
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        again = _codes(self.data, self.starts, self.ends, 1)
        return _hashes(self.codes, WIDTH, _ODD[GRAM : GRAM + WIDTH])[starts], _hashes(again, WIDTH, _ODD[GRAM + WIDTH :])[starts]

    def listed(self, places: pa.Array, width: int) -> np.ndarray:
        """The numbers of the grams or windows of so many words that each text lists by their places in it."""
        sizes = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False)
        row, at = np.repeat(np.arange(self.rows), sizes), places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        there = at <= self.count[row] - width
        return self.base[row[there]] + at[there]

    def around(self, opened: pa.Array) -> np.ndarray:
        """Starts of the long windows that select a gram at one of the places opened."""
        only = np.zeros(len(self.gram), bool)
        only[self.listed(opened, GRAM)] = True
        return self._selecting(only)

    def candidates(self, unique: pa.Array) -> np.ndarray:
        """Starts of the long windows that select a gram which is not unique."""
        again = self.selected.copy()
        again[self.listed(unique, GRAM)] = False
        return self._selecting(again)

    def _selecting(self, these: np.ndarray) -> np.ndarray:
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        same = _slide(np.where(these, self.gram, none), WIDTH - GRAM + 1, True) == self.least
        return np.flatnonzero(same & self.whole & (self.least != none))

    def staying(self, unique: pa.Array, owned: pa.Array) -> np.ndarray:
        """Whether each word stays."""
        cover = np.zeros(len(self.row) + 1, np.int64)
        if self.long:
            copies = np.zeros(len(self.least), bool)
            copies[self.candidates(unique)] = True
            copies[self.listed(owned, WIDTH)] = False
            starts = np.flatnonzero(copies)
            cover[starts] += 1
            cover[starts + WIDTH] -= 1
        return np.cumsum(cover[:-1]) == 0


def _marks(texts: pa.Array) -> Iterator[tuple[int, Marks]]:
    """The marks of a string column, null as empty, in slices of whole texts of about AT_ONCE bytes, and the first row of each."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, content = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole, at = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
        yield at, Marks(whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def _all_unique(batch: pa.RecordBatch) -> pa.Array:
    """Whether each text lists as many unique grams as it has: none of its windows is a copy."""
    return pc.fill_null(pc.equal(pc.list_value_length(batch["places"]), batch["m"]), False)


def _texts(docs: DataFrame) -> DataFrame:
    """k, t, text: k is doc_id (null: 0), t a hash of the text whose lowest bit says that doc_id is null. Rows of equal
    k and t have equal marks."""
    none = F.col("doc_id").isNull().cast("long")
    hashed = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(none)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), hashed.alias("t"), "text")


ROW = ["k", "t"]


def _only() -> list[Column]:
    """Of a gram that occurs once, its place and how many grams its text has. Of others no place is needed, so these are minima of
    their own, which Spark aggregates by hash, and not that of a struct, for which it sorts."""
    return [F.min(c).alias(c) for c in (*ROW, "pos", "m")]


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def _hashed(rows: DataFrame, hashed: str, hashes: Callable[[Marks, pa.Array | None], tuple]) -> DataFrame:
    """Columns named (hashes), k, t and pos, and m, how many there are of the text, from rows (k, t, text), or without m from rows
    (k, t, text, a list of places and perhaps m): hashes gives for the marks of texts and their lists arrays of hashes and their
    starts. A text with m places listed, all of its grams, is passed over."""
    columns, lists, counted = hashed.split(), "places" in rows.columns, "m" in rows.columns
    wanted = rows.select("k", "t", "text", *(["places"] if lists else []), *(["m"] if counted else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if counted:
                batch = batch.filter(pc.invert(_all_unique(batch)))
            k, t = (batch[c].to_numpy(zero_copy_only=False) for c in ROW)
            for first, marks in _marks(batch["text"]):
                if not marks.long:
                    continue
                *values, starts = hashes(marks, batch["places"].slice(first, marks.rows) if lists else None)
                row = marks.row[starts]
                made = [*values, k[first + row], t[first + row], (starts - marks.base[row]).astype(np.int32)]
                if not lists:
                    made.append(np.bincount(row, minlength=marks.rows)[row].astype(np.int32))
                yield pa.RecordBatch.from_arrays([_long(x) for x in made], names=names)

    names = [*columns, *ROW, "pos", *([] if lists else ["m"])]
    return wanted.mapInArrow(run, ", ".join(f"{c} {'int' if c in ('pos', 'm') else 'long'}" for c in names))


def grams(texts: DataFrame) -> DataFrame:
    """h, k, t, pos of every selected gram, and m, how many the text has."""

    def selected(marks: Marks, _: None) -> tuple:
        where = np.flatnonzero(marks.selected)
        return marks.gram[where], where

    return _hashed(texts, "h", selected)


def _candidates(joined: DataFrame) -> DataFrame:
    """a, b (the two hashes), k, t, pos of every window of rows (k, t, text, places: unique grams) that may be a copy."""

    def which(marks: Marks, places: pa.Array) -> tuple:
        starts = marks.candidates(places)
        return *marks.windows(starts), starts

    return _hashed(joined, "a b", which)


def _opened(joined: DataFrame) -> DataFrame:
    """a, b, k, t, pos of the windows around the places (grams that come again) of rows of history."""

    def which(marks: Marks, places: pa.Array) -> tuple:
        starts = marks.around(places)
        return *marks.windows(starts), starts

    return _hashed(joined, "a b", which)


def _lists(places: DataFrame, name: str) -> DataFrame:
    return places.groupBy(*ROW).agg(F.collect_list("pos").alias(name))


class Level:
    """Runs of one kind: tables bucketed and sorted by hash columns, in the shared folder."""

    def __init__(self, spark: SparkSession, keys: list[str], merge: Callable[[DataFrame], DataFrame], max_runs: int) -> None:
        self.spark, self.keys, self.merge, self.max_runs = spark, keys, merge, max_runs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, str] = {}  # table name: path

    def write(self, run: DataFrame) -> str:
        name, path = f"weftline_run_{uuid.uuid4().hex}", shared_path(self.spark, "run")
        self.runs[name] = path
        run.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", path).format("parquet").saveAsTable(name)
        return name

    def others(self, *but: str) -> list[DataFrame]:
        """The hash columns of all runs but the named ones, for merge joins."""
        return [self.spark.table(name).select(*self.keys).hint("merge") for name in self.runs if name not in but]

    def compact(self) -> None:
        """Merges all runs into one, once there are too many."""
        if len(self.runs) > self.max_runs:
            old = dict(self.runs)
            # Read by path: a union of bucketed tables may be taken for bucketed itself.
            self.write(self.merge(self.spark.read.parquet(*old.values())))
            self.drop(old)

    def drop(self, runs: dict[str, str] | None = None) -> None:
        for name, path in (dict(self.runs) if runs is None else runs).items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, path)
            self.runs.pop(name, None)


def _merged_grams(runs: DataFrame) -> DataFrame:
    return runs.groupBy("h").agg(F.sum("n").alias("n"), *_only())


class FingerprintIndex:
    """Both levels of runs, and the batches behind them. Batches come in the order of places: each document of a batch
    comes after all documents of the batches before."""

    def __init__(self, spark: SparkSession, max_runs: int = MAX_RUNS) -> None:
        self.spark = spark
        self.grams = Level(spark, ["h"], _merged_grams, max_runs)
        self.windows = Level(spark, ["a", "b"], lambda runs: runs.select("a", "b").distinct(), max_runs)
        self.history: list[DataFrame] = []
        #: Documents of history read again for each batch.
        self.read_again: list[int] = []

    def append(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Adds a batch and returns the marks of its documents: (k, t, places of unique grams, m: how many grams), (k, t, owned windows).
        ``kept`` takes the marks of any number of batches."""
        texts = _texts(batch)
        run = self.grams.write(grams(texts).groupBy("h").agg(F.count("*").alias("n"), *_only()))
        unique = self.spark.table(run).filter("n = 1")
        for other in self.grams.others(run):
            unique = unique.join(other, "h", "left_anti")
        places = cut(unique.groupBy(*ROW).agg(F.collect_list("pos").alias("places"), F.max("m").alias("m")))
        found = _candidates(texts.join(places, ROW, "left")).select("a", "b", F.lit(1).alias("now"), *ROW, "pos")
        opened = self._again(run)
        if opened is not None:
            found = found.unionByName(opened.select("a", "b", F.lit(0).alias("now"), *ROW, "pos"))
        # The least place, those of history before all of the batch: it owns the sequence.
        place = F.min(F.struct("now", F.col("t").bitwiseAND(F.lit(1)).alias("none"), "k", "pos", "t")).alias("first")
        run = self.windows.write(found.groupBy("a", "b").agg(place).select("a", "b", "first.*"))
        owned = self.spark.table(run).filter("now = 1")
        for other in self.windows.others(run):
            owned = owned.join(other, ["a", "b"], "left_anti")
        owned = cut(_lists(owned, "owned"))
        self.history.append(batch)
        self.grams.compact()
        self.windows.compact()
        release(self.spark)
        return places, owned

    def _again(self, run: str) -> DataFrame | None:
        """The windows, not hashed so far, around grams that history has once and the run again."""
        new = self.spark.table(run).select("h").hint("merge")
        met = [self.spark.table(name).join(new, "h", "left_semi") for name in self.grams.runs if name != run]
        if not met:
            self.read_again.append(0)
            return None
        # Only grams that come again are left here; those that history has once were not opened before.
        out = _merged_grams(reduce(DataFrame.unionByName, met)).filter("n = 1")
        opened = cut(_lists(out, "places"))
        rows, size = opened.agg(F.count("*"), F.sum(F.size("places"))).first()
        self.read_again.append(rows)
        if not rows:
            return None
        before = reduce(DataFrame.unionByName, [_texts(batch) for batch in self.history])
        # Broadcast behind a count of rows and places only, or else joined by shuffle.
        few = rows <= SMALL and size <= 10 * SMALL
        return _opened(before.join(F.broadcast(opened) if few else opened, ROW))

    def drop(self) -> None:
        self.grams.drop()
        self.windows.drop()


def kept(docs: DataFrame, marks: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row of docs, by the
    marks that its batches got."""
    joined = _texts(docs)
    for i in range(2):
        joined = joined.join(reduce(DataFrame.unionByName, [m[i] for m in marks]), ROW, "left")

    def written(rows: pa.RecordBatch, words: list[int], left: list[int], texts: list[bytes]) -> pa.RecordBatch:
        k, t = (rows[c].to_numpy(zero_copy_only=False) for c in ROW)
        n, stays = np.asarray(words, np.int64), np.asarray(left, np.int64)
        columns = [pa.array(k, mask=(t & 1) == 1), pa.array(n), pa.array(n - stays), pa.array(texts, pa.binary()).view(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            easy = _all_unique(batch)
            whole, rest = batch.filter(easy), batch.filter(pc.invert(easy))
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                split = [utf8(text).split() for text in part["text"].to_pylist()]
                sizes = [len(words) for words in split]
                yield written(part, sizes, sizes, [b" ".join(words) for words in split])
            for first, marks in _marks(rest["text"]):
                part, base, out = rest.slice(first, marks.rows), marks.base.tolist(), []
                stays = marks.staying(part["places"], part["owned"])
                left = np.diff(np.concatenate([[0], np.cumsum(stays)])[marks.base])
                for i, (n, some) in enumerate(zip(marks.count.tolist(), left.tolist())):
                    words = marks.data[marks.offsets[i] : marks.offsets[i + 1]].tobytes().split()
                    out.append(b" ".join(words if some == n else compress(words, stays[base[i] : base[i + 1]].tolist())))
                yield written(part, marks.count, left, out)

    small_batches(docs.sparkSession)
    return joined.select(*ROW, "text", "places", "m", "owned").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def deduplicate_in_batches(docs: DataFrame, batches: int = BATCHES, max_runs: int = MAX_RUNS) -> DataFrame:
    """kept of documents that come in batches of rising doc_id, each joined with the index of those before."""
    index = FingerprintIndex(docs.sparkSession, max_runs)
    # Percentiles of longs, not of doubles, which would round ids beyond 2**53.
    edges = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    edges, key, marks = sorted(set(edges or [])), F.col("doc_id"), []
    try:
        for low, high in zip([None, *edges], [*edges, None]):
            part = docs
            if low is not None:
                part = part.filter((key > low) | key.isNull()) if high is None else part.filter(key > low)
            if high is not None:
                part = part.filter(key <= high)
            marks.append(index.append(part))
    finally:
        index.drop()  # the marks have been cut
    return kept(docs, marks)
