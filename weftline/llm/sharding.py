"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group, which stays in one shard unless it is larger than a shard. The
items that are packed are bounded in number at any input size: a group of more than a
``GRAIN``-th of a shard is an item of its own (there are at most shards * GRAIN of them), and the
smaller groups are bundled by a hash of their text into COARSE + FINE bundles, of which the fine
ones fill the gaps. The driver packs only these items; sizes are exact sums over all rows.

Best fit: items by falling size enter the open shard with the least remaining capacity that still
holds them, found by bisection in a height-balanced search tree. The capacity is the smallest for
which the given number of shards suffices, so the shards end up near equal; items larger than an
even share get shards of their own, and the rest is shared evenly by the others. A group larger than
a shard is cut by a hash of doc_id and row number into pieces of at most a shard.

Defined results: a null text has size OVERHEAD and forms a group with other null texts (not with empty
ones); rows are told apart by a number of their own, so rows of equal or null doc_id, or equal in all
columns, are dealt and numbered like any others (those of a group larger than a shard over several shards);
slots follow doc_id (null first), size, checksum and row number; a text of any length counts by its bytes
only; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

OVERHEAD = 16
GRAIN = 128
#: A 20-bit hash of the text: below FINE_SPAN, 16 values make a fine bundle, above it 512 a coarse one.
SPAN, FINE_SPAN, FINE_STEP, COARSE_STEP = 1 << 20, 1 << 16, 16, 512
#: Parts into which a group larger than a shard can be cut.
PIECES = 512
#: Parts of a shard that are numbered on their own before their counts are added up.
SLOT_PARTS = 1024


class Tree:
    """A treap of (remaining capacity, shard) with hashed priorities: insert, remove and the least key not
    below a bound, each in logarithmic depth."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    @staticmethod
    def _priority(key: tuple[int, int]) -> bytes:
        return hashlib.blake2b(repr(key).encode(), digest_size=8).digest()

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _join(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self._priority(key), None, None]), high)

    def take_from(self, bound: int) -> tuple[int, int] | None:
        """Removes and returns the least key with remaining capacity of bound or more."""
        low, high = self._split(self.root, (bound, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        key = node[0]
        _, rest = self._split(high, (key[0], key[1] + 1))
        self.root = self._join(low, rest)
        return key


def pack(sizes: Sequence[int], capacity: int, bins: int) -> list[int] | None:
    """Bin of each item, sizes falling; None if more than the given bins of the capacity are needed."""
    tree, opened, out = Tree(), 0, []
    for size in sizes:
        got = tree.take_from(size)
        if got is None:
            if opened == bins or size > capacity:
                return None
            got, opened = (capacity, opened), opened + 1
        tree.insert((got[0] - size, got[1]))
        out.append(got[1])
    return out


def best_fit_decreasing(items: Sequence[tuple[str, int]], bins: int) -> dict[str, int]:
    """Bin of each item name, for the least capacity that works (within a 5000th)."""
    order = sorted(items, key=lambda x: (-x[1], x[0]))
    out: dict[str, int] = {}
    rest, left = sum(s for _, s in order), bins
    while left > 1 and order and order[0][1] * left > rest:  # larger than an even share
        name, size = order.pop(0)
        out[name], rest, left = bins - left, rest - size, left - 1
    sizes = [s for _, s in order]
    low = max(-(-rest // left), sizes[0] if sizes else 0)
    high, found = low, pack(sizes, low, left)
    step = max(1, low // 5000)
    while found is None:  # widen, then halve
        high += step
        step *= 2
        found = pack(sizes, high, left)
    while high - low > max(1, low // 5000):
        mid = (low + high) // 2
        got = pack(sizes, mid, left)
        low, high, found = (low, mid, got) if got is not None else (mid, high, found)
    return out | {name: bins - left + b for (name, _), b in zip(order, found)}


def _bundle(h: Column) -> Column:
    """Name of the bundle of a group key (32 hex digits)."""
    at = F.conv(F.substring(h, 1, 5), 16, 10).cast("int")
    fine = F.concat(F.lit("f"), F.floor(at / FINE_STEP).cast("string"))
    return F.when(at < FINE_SPAN, fine).otherwise(F.concat(F.lit("c"), F.floor(at / COARSE_STEP).cast("string")))


def _piece() -> Column:
    return F.pmod(F.xxhash64("doc_id", "nth", F.lit("piece")), F.lit(PIECES)).cast("int")


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs (columns doc_id and text)."""
    spark = docs.sparkSession
    # Written once, row numbers with it, so that they are the same whenever a task is run again.
    rows = cut(docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))).alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("0" * 32)).alias("h"),
        F.monotonically_increasing_id().alias("nth"),
    ))
    groups = cut(rows.groupBy("h").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    even = max(1, total // shards)
    grain = max(1, even // GRAIN)
    # Bounded: groups above the grain are at most shards * GRAIN (and a few), bundles as many as the span has.
    large = groups.filter(F.col("bytes") > grain)
    named = F.when(F.col("bytes") > grain, F.col("h")).otherwise(_bundle(F.col("h")))
    items = [(r["item"], r["bytes"]) for r in groups.groupBy(named.alias("item")).agg(F.sum("bytes").alias("bytes")).collect()]
    huge = sorted(name for name, size in items if len(name) == 32 and size > even)
    parts: dict[tuple[str, int], str] = {}
    if huge:
        counted = rows.filter(F.col("h").isin(huge)).groupBy("h", _piece().alias("p")).agg(F.sum("size").alias("bytes"))
        items = [x for x in items if x[0] not in set(huge)]
        filled: dict[str, list[int]] = {}
        for r in sorted(counted.collect(), key=lambda r: (r["h"], r["p"])):
            at = filled.setdefault(r["h"], [0])
            if at[-1] and at[-1] + r["bytes"] > even:
                at.append(0)
            at[-1] += r["bytes"]
            parts[r["h"], r["p"]] = f"{r['h']}/{len(at) - 1}"
        items += [(f"{h}/{i}", size) for h, at in filled.items() for i, size in enumerate(at)]
    where = best_fit_decreasing(items, shards)
    # One row for each item, or part of a huge group: a table of bounded size.
    lookup = [(name, -1, b) for name, b in where.items() if "/" not in name] + [(h, p, where[name]) for (h, p), name in parts.items()]
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    places = spark.createDataFrame(lookup, schema)
    big = F.broadcast(large.select(F.col("h").alias("big")))
    part = F.when(F.col("h").isin(huge), _piece()).otherwise(F.lit(-1)) if huge else F.lit(-1)
    placed = (
        rows.join(big, F.col("h") == F.col("big"), "left")
        .withColumns({"item": F.when(F.col("big").isNotNull(), F.col("h")).otherwise(_bundle(F.col("h"))), "part": part})
        .join(F.broadcast(places), ["item", "part"], "left")
        .select("doc_id", "size", "text_crc32", "nth", "shard")
    )
    return number(cut(placed), ["shard"], ["doc_id", "size", "text_crc32", "nth"]).drop("nth")


def number(df: DataFrame, by: list[str], keys: list[str], parts: int = SLOT_PARTS) -> DataFrame:
    """df with ``slot``: 0, 1, ... without gaps in every group of ``by``. Each group is numbered in parts (by
    a hash of the keys, which tell rows apart), and the counts before a part are added; no task holds a group."""
    dealt = df.withColumn("slot_part", F.pmod(F.xxhash64(*keys, F.lit("slot")), F.lit(parts)))
    counts = dealt.groupBy(*by, "slot_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("slot_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "slot_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*by, "slot_part").orderBy(*keys)
    return (
        dealt.withColumn("inside", F.row_number().over(inside))
        .join(offsets, [*by, "slot_part"])
        .withColumn("slot", F.col("inside") - 1 + F.col("offset"))
        .drop("slot_part", "inside", "offset")
    )
