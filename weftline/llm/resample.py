"""Importance resampling towards a target distribution, over hashed word n-grams.

Features of a text are its words and pairs of neighbouring words, hashed by CRC-32 into buckets. A vectorised automaton
makes them straight from the UTF-8 buffer of an Arrow batch: bytes are lower-cased and classified with look-up tables, words
begin and end where the class changes, and the CRCs of all words advance together, one byte of each at a step, by the CRC's
table; the pairs go on from the states of their first words. Counts of the buckets are summed in each task and then over all
tasks, for the raw table and the target, which gives each bucket its gain, a log ratio. A text weighs the mean gain of its
features; with Gumbel noise from a hash of its doc_id added, the highest scores are a sample without replacement
in proportion to the weights' exponentials.

The model is one number a bucket, so it may go through the driver at any input size. Scores are ranked by ranges, no task
ranks all.

Defined results: a null text has no words; a text without words weighs 0; a null doc_id has the noise of the name
``null`` and comes after all others in a tie; rows equal in score and doc_id are ranked one after the other in some
order; texts of any length are read whole; empty tables give no rows, an empty target no features; other columns
are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .arrow_words import Words, sliced
from .common import cut

#: Fixed values of the sample: buckets, percentage drawn, words that a drawn text must have, name of the noise.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Steps that all words advance together; what is longer, goes on by itself.
TOGETHER = 48

_ALL = np.arange(256)
#: Word bytes: digits, letters and everything beyond ASCII.
WORD_BYTES = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x41) & (_ALL <= 0x5A)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 0x20, _ALL).astype(np.uint8)
#: The table of CRC-32: eight shifts of each byte under the reversed polynomial.
CRC = reduce(lambda c, _: np.where(c & 1, (c >> 1) ^ 0xEDB88320, c >> 1), range(8), _ALL.astype(np.uint32)).astype(np.uint32)
_ONES, _BYTE, _EIGHT = np.uint32(0xFFFFFFFF), np.uint32(0xFF), np.uint32(8)


def _step(state: np.ndarray, byte: np.ndarray | np.uint8) -> np.ndarray:
    return CRC[(state ^ byte) & _BYTE] ^ (state >> _EIGHT)


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states after the bytes from starts to ends, each going on from its own state."""
    sizes = ends - starts
    order = np.argsort(np.uint16(0xFFFF) - np.minimum(sizes, 0xFFFF).astype(np.uint16), kind="stable")  # longest first
    now, at, size = state[order], starts[order], sizes[order]
    longest = int(size[0]) if len(size) else 0
    going = np.searchsorted(-size, -np.arange(min(longest, TOGETHER)), "left")  # by step: words longer than it
    for j, m in enumerate(going.tolist()):
        now[:m] = _step(now[:m], data[at[:m] + j])
    for i in range(int(np.searchsorted(-size, -TOGETHER, "left"))):
        rest = data[at[i] + TOGETHER : at[i] + size[i]].tobytes()
        now[i] = np.uint32(zlib.crc32(rest, int(now[i] ^ _ONES))) ^ _ONES
    out = np.empty_like(state)
    out[order] = now
    return out


def features(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature of a slice."""
    data = LOWER[words.data]
    single = advance(np.full(len(words.starts), _ONES), data, words.starts, words.ends)
    first = np.flatnonzero(words.row[1:] == words.row[:-1])
    pair = advance(_step(single[first], np.uint8(0x20)), data, words.starts[first + 1], words.ends[first + 1])
    crc = np.concatenate([single, pair]) ^ _ONES
    return (crc % np.uint32(buckets)).astype(np.int64), np.concatenate([words.row, words.row[first]])


def counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how many features of all texts (column text) are in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for words in sliced(batch.column(0), WORD_BYTES):
                total += np.bincount(features(words, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths, from counts of the raw table and of the target: one row a bucket at most."""
    s, t = ({r["bucket"]: r["n"] for r in df.collect()} for df in (raw, target))
    s_all, t_all = (float(sum(x.values()) + buckets) for x in (s, t))
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1.0) * s_all / ((s.get(b, 0) + 1.0) * t_all))) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the mean gain of the features, rounded down) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in sliced(batch.column(1), WORD_BYTES):
                bucket, row = features(words, len(gain))
                n = np.bincount(row, minlength=words.rows)
                total = np.bincount(row, weights=gain[bucket], minlength=words.rows).astype(np.int64)
                made = [np.bincount(words.row, minlength=words.rows), n, np.where(n > 0, total // np.maximum(n, 1), 0)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, words.rows), *map(pa.array, made)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a hash of seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (1, 2, ... among the drawn, else null) of every row of docs."""
    gain = gains(counts(docs, buckets), counts(target, buckets), buckets)
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # Rows that nothing else tells apart are, by where they are in this table.
    scored = cut(scored.withColumn("nth", F.monotonically_increasing_id()))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ordered = able.withColumns({"falling": -F.col("score"), "none": F.col("doc_id").isNull()})
    place = numbered(ordered, [], ["falling", "none", "doc_id", "nth"], "place")
    ranked = place.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*out))
