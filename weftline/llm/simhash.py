"""SimHash near-duplicate classes with pigeonring filtering.

The 64 bits of a fingerprint are bits + 1 segments on a ring. If two fingerprints differ in at most
bits bits, there is a segment from which every chain of l = 1, 2, ... consecutive segments differs in at
most l * bits / (bits + 1) bits in all (rounded down; for BITS: 0, 1, 2, 3, 4). Fingerprints are dealt by that first
segment, which must be equal; inside such a bucket the chain is followed segment by segment and a pair
is dropped at the first budget it exceeds, so that few pairs see the last link, the full distance.

Only distinct fingerprints are compared, so copies cost nothing. A bucket of more than ``BUCKET``
fingerprints is dealt again by two links of the chain: its members go where the first two segments are
theirs, and also, as probes, where one zero bit of the second segment is set (of two fingerprints that
differ in one bit there, exactly one has the zero). A bucket that is still larger is cut into blocks, and
every two blocks meet in a task of bounded memory. No pairs are emitted: a task returns for its bucket a
star from each member to the least member it is connected with, at most one row a member.

Defined results: a null or empty text has fingerprint 0 and is linked like any other; a text of fewer words
than a shingle is one shingle; rows with equal doc_id each get a row; a null doc_id takes part but is
never a component_id while the group has another; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_slices, small, utf8
from .components import components

#: Words of a shingle, seed of XXH64, bits that near duplicates may differ in.
WORDS, SEED, BITS = 4, 42, 4
BUCKET = 4096
CHUNK = 1 << 16


def ring(bits: int) -> tuple[tuple[int, int], ...]:
    """First bit and width of each of the bits + 1 segments."""
    if not 2 <= bits < 32:
        raise ValueError("bits must be from 2 to 31")
    widths = [64 // (bits + 1) + (i < 64 % (bits + 1)) for i in range(bits + 1)]
    return tuple((sum(widths[:i]), w) for i, w in enumerate(widths))


_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    split = utf8(text).lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(split))
    total = len(split) - k + 1
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, total, CHUNK):
        a, b = starts[at : min(total, at + CHUNK)].tolist(), ends[at + k - 1 : min(total, at + CHUNK) + k - 1].tolist()
        h = np.fromiter((xxh64_intdigest(joined[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))
        lanes = h.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE
    set_bits = (2 * counts > total).ravel()
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        return {"doc_id": got["doc_id"], "fp": np.array([fingerprint(t, words) for t in got["text"]], np.uint64).view(np.int64)}

    return map_slices(docs.select("doc_id", "text"), rows, "doc_id long, fp long")


def _segment(fp: Column, i: int, bits: int) -> Column:
    start, width = ring(bits)[i % (bits + 1)]
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _code(level: int, i: int, bits: Column) -> Column:
    return F.lit((level << 60) | (i << 50)).bitwiseOR(bits)


def _first_links(nodes: DataFrame, bits: int) -> DataFrame:
    """(k, fp): every fingerprint under each segment as the start of a chain."""
    fp = F.col("fp")
    return nodes.select("fp", F.explode(F.array(*[_code(1, i, _segment(fp, i, bits)) for i in range(bits + 1)])).alias("k"))


def _second_links(rows: DataFrame, bits: int) -> DataFrame:
    """(k, fp, probe) of rows (k, fp) of large buckets: two links of the chain."""
    fp, out = F.col("fp"), []
    for i in range(bits + 1):
        a, b, (_, width) = _segment(fp, i, bits), _segment(fp, i + 1, bits), ring(bits)[(i + 1) % (bits + 1)]
        exact = F.struct(_code(2, i, F.shiftleft(a, width).bitwiseOR(b)).alias("k"), F.lit(False).alias("probe"))
        probes = [F.when(b.bitwiseAND(F.lit(1 << j)) == 0, F.struct(_code(2, i, F.shiftleft(a, width).bitwiseOR(b.bitwiseOR(F.lit(1 << j)))).alias("k"), F.lit(True).alias("probe"))) for j in range(width)]
        mine = rows.filter(F.shiftrightunsigned("k", 50).bitwiseAND(F.lit(31)) == i)
        out.append(mine.select("fp", F.inline(F.filter(F.array(exact, *probes), lambda x: x.isNotNull()))))
    done = out[0]
    for part in out[1:]:
        done = done.union(part)
    return done.select("k", "fp", "probe")


def _blocks(rows: DataFrame, counts: DataFrame, bucket: int) -> DataFrame:
    """rows of buckets beyond the bound under every two blocks that they belong to (column block)."""
    n = F.ceil(F.col("n") * 2 / bucket).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: 1 + F.least(F.col("mine"), c) * F.col("blocks") + F.greatest(F.col("mine"), c))
    return rows.join(counts.select("k", n.alias("blocks")), "k").withColumn("mine", mine).select("k", F.explode(both).alias("block"), "fp", "probe")


def chains(x: np.ndarray, start: int, bits: int = BITS) -> np.ndarray:
    """Positions in x (differences of pairs, equal in the segment start) of those within all budgets of the chain."""
    alive, spent = np.arange(len(x)), np.zeros(len(x), np.int64)
    for link in range(1, bits + 1):
        at, width = ring(bits)[(start + link) % (bits + 1)]
        spent = spent + np.bitwise_count(x & np.uint64(((1 << width) - 1) << at))
        keep = spent <= (link + 1) * bits // (bits + 1)
        alive, x, spent = alive[keep], x[keep], spent[keep]
    return alive


def star(fps: np.ndarray, probe: np.ndarray, start: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Members of one bucket (sorted) that are connected with a smaller one, and the least such member."""
    n, root = len(fps), np.arange(len(fps))
    step = max(1, (1 << 20) // n)
    for at in range(0, n - 1, step):
        rows = np.arange(at, min(n, at + step))
        r, c = np.nonzero((rows[:, None] < np.arange(n)[None, :]) & (root[rows][:, None] != root[None, :]) & ~(probe[rows][:, None] & probe[None, :]))
        hit = chains(fps[rows[r]] ^ fps[c], start, bits)
        a, b = root[rows[r[hit]]], root[c[hit]]
        if len(a):
            parent: dict[int, int] = {}

            def find(v: int) -> int:
                while (p := parent.get(v, v)) != v:
                    parent[v] = parent.get(p, p)
                    v = p
                return v

            for u, v in set(zip(a.tolist(), b.tolist())):
                u, v = find(u), find(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
            new = np.arange(n)
            for v in parent:
                new[v] = find(v)
            root = new[root]
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def _stars(batches: Iterator[pa.RecordBatch], bits: int = BITS) -> Iterator[pa.RecordBatch]:
    """Rows (k, block, fp, probe) sorted by these; a bucket may go on in the next batch."""
    rest: list[np.ndarray] | None = None

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]

    def found(columns: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        k, block, fp, probe = columns
        new = np.flatnonzero((k[1:] != k[:-1]) | (block[1:] != block[:-1])) + 1
        edges = [0, *new.tolist(), *([len(k)] if last else [])]
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for i, j in zip(edges, edges[1:]):
            if j - i > 1:
                u, v = star(fp[i:j].view(np.uint64), probe[i:j].astype(bool), int(k[i] >> 50) & 31, bits)
                a.append(u), b.append(v)
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])
        return out, [x[edges[-1] :] for x in columns]

    for batch in batches:
        if batch.num_rows:
            columns = read(batch)
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            out, rest = found(columns, False)
            yield out
    if rest is not None and len(rest[0]):
        yield found(rest, True)[0]


def links(nodes: DataFrame, bucket: int = BUCKET, bits: int = BITS) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs within bits bits; nodes: distinct fp."""
    first = _first_links(nodes, bits)
    # At most 5 * 2**13 keys for BITS: small enough for any executor.
    large = F.broadcast(cut(first.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > bucket)))
    rows = first.join(large.select("k"), "k", "left_anti").select("k", F.lit(0).alias("block"), "fp", F.lit(False).alias("probe"))
    if not large.isEmpty():
        second = _second_links(first.join(large.select("k"), "k", "left_semi"), bits)
        counts = second.groupBy("k").agg(F.count("*").alias("n"), F.min("probe").alias("only_probes")).filter(~F.col("only_probes"))
        fits = counts.filter(F.col("n") <= bucket).select("k")
        beyond = cut(counts.filter(F.col("n") > bucket).select("k", "n"))
        rows = rows.union(second.join(fits, "k").select("k", F.lit(0).alias("block"), "fp", "probe"))
        if not beyond.isEmpty():
            rows = rows.union(_blocks(second, beyond, bucket))
    dealt = rows.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "block").sortWithinPartitions("k", "block", "fp")
    return dealt.mapInArrow(partial(_stars, bits=bits), "a long, b long")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of all linked documents) of every row of docs."""
    fps = cut(fingerprints(docs, words))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    member = cut(components(links(nodes.select("fp"), bucket, bits)).withColumnRenamed("node", "fp"))
    least = nodes.join(member, "fp").groupBy("root").agg(F.min("first").alias("least"))
    known = nodes.join(member.join(least, "root").select("fp", "least"), "fp", "left")
    return fps.join(known.select("fp", F.coalesce("least", "first").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of docs of each group of near duplicates, all columns as they are: that of the least doc_id, a null
    one after all others; of several texts under that doc_id, the one of the least digest; of repeated rows,
    one. Rows go by a key of doc_id and text, so neither null nor repeated doc_ids join what is not alike."""
    key = "row_key"
    while key in (c.lower() for c in docs.columns):
        key += "_"
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    keyed = docs.withColumn(key, F.unhex(digest))

    def rows(got: dict[str, list]) -> dict[str, list]:
        return {"doc_id": got["doc_id"], "k": got[key], "fp": np.array([fingerprint(t, words) for t in got["text"]], np.uint64).view(np.int64)}

    fps = map_slices(keyed.select("doc_id", "text", key), rows, "doc_id long, k binary, fp long")
    nodes = cut(fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("first")))
    member = cut(components(links(nodes.select("fp"), bits=bits)).withColumnRenamed("node", "fp"))
    kept = nodes.join(member, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return keyed.join(kept.select(F.col("first.k").alias(key)), key, "left_semi").dropDuplicates([key]).select(*docs.columns)


# Near duplicates by the similarity of their shingles.
#
# Fingerprints alone find pairs of similarity 0.8 only at 16 differing bits of 64, where segments are too short to tell fingerprints
# apart. So candidates come from shingles: nodes that agree in all of ROWS least hashes of one of BANDS bands meet in a bucket. There the
# pigeonring chain and the full distance prune them, and what is left is verified by the shingles themselves.

#: Words of a shingle, similarity that makes near duplicates, bits that fingerprints of such pairs differ in at most.
SIMILAR_WORDS, SIMILARITY, SIMILAR_BITS = 5, 0.8, 18
BANDS, ROWS = 14, 5
#: Least hashes by which a pair is verified; texts of fewer shingles are compared whole. Of an estimate the standard error is allowed for.
SKETCH, ERROR = 256, 0.025
#: Rows of a block with sketches, whose pairs are compared by matrices.
VERIFIED = 2048
_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64) for j in range(max(16, BANDS * ROWS))], np.uint64)


def shingles(text: str | None, words: int = SIMILAR_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted: words in lower case (A-Z), fewer words than a shingle are one."""
    from .substr import _codes, _edges

    data = np.frombuffer(utf8(text).lower(), np.uint8)
    starts, ends = _edges(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    codes, k = _codes(data, starts, ends, 0), min(words, len(starts))
    h = np.zeros(len(codes) - k + 1, np.uint64)
    for j in range(k):
        h += codes[j : j + len(h)] * _ODD[j]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def bits_of(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of distinct shingles."""
    if not len(hashes):
        return 0
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), CHUNK):
        lanes = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").tobytes(), "little")


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its ROWS least hashes, each under a factor of its own."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 1024):
        mixed = _ODD[: len(least), None] * hashes[None, at : at + 1024]
        mixed ^= mixed >> np.uint64(31)
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS) * _ODD[None, :ROWS]
    return (rows.sum(axis=1, dtype=np.uint64) ^ _ODD[:BANDS]) & np.uint64(0x7FFFFFFFFFFFFFFF)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, sketch: int = SKETCH) -> bool:
    """Whether two sets have a Jaccard similarity of least or more, by their least hashes (sorted, at most sketch of each)."""
    both, whole = np.union1d(a, b), len(a) < sketch and len(b) < sketch
    both = both if whole else both[:sketch]
    if not len(both):
        return True
    shared = np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()
    return shared / len(both) >= (least if whole else least - ERROR)


def perhaps(a: list[np.ndarray], b: list[np.ndarray], least: float = SIMILARITY, sketch: int = SKETCH) -> np.ndarray:
    """Which pairs of a set of a and one of b may be ``similar``, as a matrix; it leaves out none that are. Hashes are taken in ranges from the least
    on: what two sets share in a range is a product of 0/1 matrices. Whole sets are compared exactly; what others share up to the
    range in which their union comes to ``sketch`` hashes bounds their estimate."""
    sizes = [np.array([len(x) for x in sets]) for sets in (a, b)]
    hashes, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    places, rows = np.split(place, [sizes[0].sum()]), [np.repeat(np.arange(len(n)), n) for n in sizes]
    counts = [np.bincount(p, minlength=len(hashes)) for p in places]
    common = counts[0] > 1 if a is b else (counts[0] > 0) & (counts[1] > 0)
    shared, union, bound = (np.full((len(a), len(b)), x, np.float32) for x in (0, 0, -1))
    ends = np.linspace(0, len(hashes), 33).astype(np.int64)[1:]
    start = 0
    for end in ends:
        columns = start + np.flatnonzero(common[start:end])
        for at in range(0, len(columns), 1024):
            some, both = columns[at : at + 1024], []
            column = np.full(end - start, -1)
            column[some - start] = np.arange(len(some))
            for p, r, n in zip(places, rows, sizes):
                inside = (p >= some[0]) & (p <= some[-1])
                c, r = column[p[inside] - start], r[inside]
                m = np.zeros((len(n), len(some)), np.float32)
                m[r[c >= 0], c[c >= 0]] = 1
                both.append(m)
            product = both[0] @ both[1].T
            shared += product
            union -= product
        x, y = (np.bincount(r[(p >= start) & (p < end)], minlength=len(n)) for p, r, n in zip(places, rows, sizes))
        union += (x[:, None] + y[None, :]).astype(np.float32)
        full = (bound < 0) & (union >= sketch)
        bound[full] = shared[full]
        start = end
    whole = (sizes[0] < sketch)[:, None] & (sizes[1] < sketch)[None, :]
    exact = shared.astype(np.float64) >= least * union.astype(np.float64) - 1e-6
    return np.where(whole, exact, np.where(bound < 0, shared, bound) >= (least - ERROR) * sketch - 1e-3)


def within(x: np.ndarray, bits: int = SIMILAR_BITS) -> np.ndarray:
    """Which differences x of pairs are of at most bits bits: a chain of segments within its budgets from some place of the ring
    on, and then the full distance."""
    passed = np.zeros(len(x), bool)
    for start in range(bits + 1):
        at, width = ring(bits)[start]
        begins = np.flatnonzero(~passed & ((x & np.uint64(((1 << width) - 1) << at)) == 0))
        if len(begins):
            passed[begins[chains(x[begins], start, bits)]] = True
    return passed & (np.bitwise_count(x) <= bits)


def leaders(bucket: np.ndarray, fps: np.ndarray, bits: int = SIMILAR_BITS) -> np.ndarray:
    """For each row the position of its leader: the first row of its bucket (equal numbers in a row) within bits of it that is
    led by no other. All buckets take their next leader at the same time."""
    own, free = np.arange(len(fps)), np.arange(len(fps))
    while len(free):
        of = bucket[free]
        first = np.concatenate([[True], of[1:] != of[:-1]])
        leader = free[first][np.cumsum(first) - 1]
        led = within(fps[free] ^ fps[leader], bits)
        own[free[led]] = leader[led]
        free = free[~led]
    return own


def _led(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(a, b, k, fp, more) from rows (k, part, node, fp) sorted by these: each member with its leader; leaders with themselves. more:
    the part has pairs of members that neither leads."""
    rest: list[np.ndarray] | None = None

    def found(columns: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        new = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
        end = len(columns[0]) if last else (int(new[-1]) if len(new) else 0)
        k, _, node, fp = (c[:end] for c in columns)
        bucket = np.zeros(end, np.int64)
        bucket[new[new < end]] = 1
        bucket = np.cumsum(bucket)
        members = np.bincount(bucket)[bucket] if end else np.zeros(0, np.int64)
        many = members > 1
        own = np.arange(end)
        own[many] = np.flatnonzero(many)[leaders(bucket[many], fp[many].view(np.uint64), bits)]
        made = pa.RecordBatch.from_arrays([pa.array(x) for x in (node, node[own], k, fp, members > 2)], names=["a", "b", "k", "fp", "more"])
        return made, [c[end:] for c in columns]

    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            columns = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns)]
            made, rest = found(columns, False)
            yield made
    if rest is not None and len(rest[0]):
        yield found(rest, True)[0]


def candidates(dealt: DataFrame, bucket: int = BUCKET, bits: int = SIMILAR_BITS) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of nodes: members of a bucket with their leader. dealt: k, node, fp. A bucket of more than
    ``bucket`` members is led in parts, and the leaders of the parts once more, until a part holds them. Also (k, node, fp) of
    the buckets in which other pairs are left, for ``remaining``."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, rows, left = [], dealt, None
    while True:
        large = small(rows.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > bucket))
        part = F.pmod(F.xxhash64("node", F.lit(len(found))), F.coalesce(F.ceil(F.col("n") / bucket), F.lit(1))).cast("int").alias("part")
        keyed = rows.join(large, "k", "left").select("k", part, "node", "fp")
        led = cut(keyed.repartition(parts, "k", "part").sortWithinPartitions("k", "part", "node").mapInArrow(partial(_led, bits=bits), "a long, b long, k long, fp long, more boolean"))
        if left is None:
            left = led.filter("more").select("k", F.col("a").alias("node"), "fp").union(led.filter("not more").join(large.select("k"), "k").select("k", F.col("a").alias("node"), "fp"))
        found.append(led.filter("a <> b").select("a", "b"))
        if large.isEmpty():
            break
        rows, before = cut(led.filter("a = b").join(large.select("k"), "k").select("k", F.col("a").alias("node"), "fp")), rows.join(large.select("k"), "k", "left_semi")
        if rows.count() == before.count():
            break  # all lead themselves: what else is near is left to the remaining pairs
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct(), left


def _pairs_left(batches: Iterator[pa.RecordBatch], bits: int, least: float | None) -> Iterator[pa.RecordBatch]:
    """From rows (k, block, mine, node, fp, root and, if least is given, sketch) sorted by k, block and node: without least, (k, node) of the
    members that are within bits of one of another root; with least, (a, b) that join roots by pairs that are similar, too. A block of two parts has its pairs across them
    only. A task holds one block, and a pair whose roots have been joined meanwhile is passed over."""
    rest: list[pa.RecordBatch] = []

    def near(mine: np.ndarray, fp: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        across, step = len(np.unique(mine)) > 1, max(1, (1 << 20) // len(fp))
        for at in range(0, len(fp) - 1, step):
            rows = np.arange(at, min(len(fp), at + step))
            # The full distance at once: over whole blocks it costs less than the chain, with the same pairs.
            close = np.bitwise_count(fp[rows][:, None] ^ fp[None, :]) <= bits
            close &= (rows[:, None] < np.arange(len(fp))[None, :]) & (root[rows][:, None] != root[None, :])
            if across:
                close &= mine[rows][:, None] != mine[None, :]
            yield rows, close

    def of_block(block: pa.Table) -> pa.RecordBatch:
        mine, node, fp, root = (block.column(c).to_numpy() for c in ("mine", "node", "fp", "root"))
        if least is None:
            open_ = np.zeros(len(node), bool)
            for rows, close in near(mine, fp.view(np.uint64), root) if len(fp) > 1 and (root != root[0]).any() else ():
                open_[rows] |= close.any(axis=1)
                open_ |= close.any(axis=0)
            return pa.RecordBatch.from_arrays([pa.array(block.column("k").to_numpy()[open_]), pa.array(node[open_])], names=["k", "node"])
        sets, joined, made = [np.frombuffer(x, np.uint32) for x in block.column("sketch").to_pylist()], {}, []

        def find(v: int) -> int:
            while (p := joined.get(v, v)) != v:
                joined[v] = v = joined.get(p, p)
            return v

        if len(fp) > 1 and (root != root[0]).any():
            sides = [np.flatnonzero(mine == m) for m in np.unique(mine)]
            u, v = sides[0], sides[-1]
            of_u = [sets[i] for i in u]
            close = np.bitwise_count(fp.view(np.uint64)[u][:, None] ^ fp.view(np.uint64)[v][None, :]) <= bits
            close &= root[u][:, None] != root[v][None, :]
            if close.any():
                close &= perhaps(of_u, of_u if len(sides) == 1 else [sets[i] for i in v], least)
            for i, among in zip(u.tolist(), close):
                for j in v[among].tolist():
                    if (i < j or len(sides) > 1) and (r := find(int(root[i]))) != (q := find(int(root[j]))) and similar(sets[i], sets[j], least):
                        joined[max(r, q)] = min(r, q)
                        made.append((int(node[i]), int(node[j])))
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def blocks(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        k, block = table.column("k").to_numpy(), table.column("block").to_numpy()
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), *([len(k)] if last else [])]
        for i, j in zip(edges, edges[1:]):
            yield of_block(table.slice(i, j - i))
        rest[:] = table.slice(edges[-1]).to_batches()

    for batch in batches:
        if batch.num_rows:
            yield from blocks(pa.Table.from_batches([*rest, batch]).combine_chunks(), False)
    if rest:
        yield from blocks(pa.Table.from_batches(rest).combine_chunks(), True)


def _in_blocks(rows: DataFrame, bucket: int) -> DataFrame:
    """rows (k, ...) under block and mine: a bucket of more than ``bucket`` rows is cut into parts, and every two parts (and each by itself) make a
    block of a task, so that all its pairs meet in bounded memory."""
    large = small(rows.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("k", F.ceil(F.col("n") * 2 / bucket).cast("int").alias("parts")))
    dealt = rows.join(large, "k", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda c: F.least(F.col("mine"), c).cast("long") * F.col("parts") + F.greatest(F.col("mine"), c))
    return dealt.withColumn("block", F.explode(both)).drop("parts")


def _by_block(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "k", "block").sortWithinPartitions("k", "block", "node")


def remaining(left: DataFrame, member: DataFrame, sketches: DataFrame, least: float = SIMILARITY, bucket: int = BUCKET, bits: int = SIMILAR_BITS) -> DataFrame:
    """(a, b) that join what the pairs of members and leaders have left apart: all pairs of a bucket of left (k, node, fp) that are within bits,
    in different components (member: at, root) and similar are joined, directly or through others. Most members of a bucket
    are similar to their leader, so few are left; sketches (node, sketch) go to these only."""
    rooted = left.join(member, F.col("node") == F.col("at"), "left").select("k", "node", "fp", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("k").agg(F.min("root").alias("m"), F.max("root").alias("n")).filter("m <> n").select("k")
    rooted = cut(rooted.join(several, "k", "left_semi"))
    met = _by_block(_in_blocks(rooted, bucket).select("k", "block", "mine", "node", "fp", "root")).mapInArrow(partial(_pairs_left, bits=bits, least=None), "k long, node long")
    met = cut(met.distinct())
    told = met.select("node").distinct().join(sketches, "node").dropDuplicates(["node"])
    open_ = _in_blocks(rooted.join(met, ["k", "node"], "left_semi"), min(bucket, VERIFIED)).join(told.select("node", "sketch"), "node")
    sent = _by_block(open_.select("k", "block", "mine", "node", "fp", "root", "sketch"))
    return sent.mapInArrow(partial(_pairs_left, bits=bits, least=least), "a long, b long")


def _verified(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs whose shingles are similar enough. The sketches (node, sketch) of both come by join, salted, as a leader may have
    any number of members."""
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("a"), F.lit(16)).cast("int"))
    of_b = salted.select("b", "s").distinct().join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("of_b")), "b")
    both = salted.join(of_b, ["b", "s"]).join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("of_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x, np.uint32) for x in batch.column(i).to_pylist()] for i in (2, 3)]
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y, least) for x, y in zip(*sets)], pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def keep_one_similar(docs: DataFrame, words: int = SIMILAR_WORDS, least: float = SIMILARITY, bits: int = SIMILAR_BITS, bucket: int = BUCKET) -> DataFrame:
    """One row of docs of each group of texts whose sets of shingles have a similarity of ``least`` or more, all columns as
    they are: that of the least doc_id, a null one after all others; of several texts under that doc_id, the one of the
    least digest; of repeated rows, one.

    Texts of equal shingles are one node; texts without words are one, too. Nodes of ``SKETCH`` shingles and more are compared by the
    least of them, which estimates the similarity (standard error ``ERROR`` at 0.8, allowed for). A text of any length counts
    whole; an empty table gives no rows."""
    from xxhash import xxh64_intdigest

    key = "row_key"
    while key in (c.lower() for c in docs.columns):
        key += "_"
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    keyed = docs.withColumn(key, F.unhex(digest))

    def rows(got: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": got["doc_id"], "k": got[key], "node": [], "fp": [], "bands": [], "sketch": []}
        told = set()  # copies in a slice are told once
        for text in got["text"]:
            hashes = shingles(text, words)
            node = int(np.uint64(xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))
            out["node"].append(node)
            new = node not in told
            told.add(node)
            out["fp"].append(int(np.uint64(bits_of(hashes)).view(np.int64)) if new else None)
            out["bands"].append(bands_of(hashes).view(np.int64).tolist() if new else None)
            out["sketch"].append((hashes[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() if new else None)
        return out

    marked = cut(map_slices(keyed.select("doc_id", "text", key), rows, "doc_id long, k binary, node long, fp long, bands array<long>, sketch binary"))
    nodes = marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("first"))
    told = marked.filter("fp is not null")
    pairs, left = candidates(told.select(F.explode("bands").alias("k"), "node", "fp").distinct(), bucket, bits)
    pairs = cut(pairs)
    paired = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sketches = cut(told.select("node", "sketch").join(paired, "node", "left_semi").dropDuplicates(["node"]))
    led = cut(_verified(pairs, sketches, least))
    member = cut(components(led).withColumnRenamed("node", "at"))
    more = cut(remaining(left, member, told.select("node", "sketch"), least, bucket, bits))
    if not more.isEmpty():
        member = cut(components(led.unionByName(more)).withColumnRenamed("node", "at"))
    kept = nodes.join(member, F.col("node") == F.col("at"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return keyed.join(kept.select(F.col("first.k").alias(key)), key, "left_semi").dropDuplicates([key]).select(*docs.columns)
