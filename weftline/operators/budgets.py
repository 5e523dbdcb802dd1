"""Greedy budgets: in the order of a seeded hash, a row is admitted if it still fits, else passed over, on and on.

Whether a row fits depends on all rows before it, yet few decisions do. A purse's rows are dealt into ``PARTS`` intervals of their
hash, and a round decides on many of them:

1. rows larger than what is left will never fit, and drop out;
2. of the others, whole intervals are admitted as long as their running sum fits;
3. the first interval that does not fit is gone through row by row, in one task, which tells what is left behind it.

Rounds go on behind that interval, for all purses at once; what is left then is less than something passed over, so
that few rows remain. Once every purse has at most ``FEW`` open rows, they are gone through row by row.

Amounts count to the millionth, as whole numbers, so sums do not depend on their order. A null or negative amount is not
admitted; rows equal in identity have their decisions one by one in the order of amounts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut
from .folds import ordered_fold

PARTS, FEW, UNIT = 4096, 200_000, 1_000_000


class _Purse:
    """feed(amount, left) -> (admitted, left after); left is what the first row finds."""

    def __init__(self) -> None:
        self.left: int | None = None

    def feed(self, amount: int, left: int) -> tuple[bool, int]:
        self.left = left if self.left is None else self.left
        admitted = amount <= self.left
        self.left -= amount if admitted else 0
        return admitted, self.left


def _one_by_one(rows: DataFrame, by: list[str]) -> DataFrame:
    return cut(ordered_fold(rows, by, ["_order", "_nth"], ["_amount", "_left"], _Purse, "_in boolean, _after long", ["_nth"]))


def admitted(rows: DataFrame, amount: str, purses: DataFrame, keys: Sequence[str], seed: int, identity: Sequence[str], parts: int = PARTS, few: int = FEW) -> DataFrame:
    """The rows of ``rows`` that their purses admit. purses: keys and budget, one row each; rows of other keys are not admitted."""
    by = [f"_key{i}" for i in range(len(keys))] or ["_key0"]
    named = [F.col(k).alias(b) for k, b in zip(keys, by)] or [F.lit(0).alias("_key0")]
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]), 256)
    whole = cut(rows.withColumn("_nth", F.monotonically_increasing_id()))
    units = F.round(F.col(amount).cast("double") * UNIT).cast("long").alias("_amount")
    slim = whole.select(*named, "_nth", units, order.alias("_order")).withColumn("_part", F.floor(F.conv(F.substring("_order", 1, 6), 16, 10).cast("long") * parts / (1 << 24)).cast("int")).filter("_amount >= 0")
    slim = cut(slim)
    state = cut(purses.select(*named, F.floor(F.col("budget").cast("double") * UNIT).cast("long").alias("_left"), F.lit(0).alias("_at")))
    few_purses = state.count() <= FEW
    small = F.broadcast if few_purses else (lambda df: df)
    taken: list[DataFrame] = []
    while True:
        known = reduce(lambda df, b: df.withColumnRenamed(b, f"{b}_"), by, state)
        same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"{b}_")) for b in by])
        open_ = slim.join(small(known), same).drop(*[f"{b}_" for b in by]).filter((F.col("_part") >= F.col("_at")) & (F.col("_amount") <= F.col("_left")))
        sums = cut(open_.groupBy(*by, "_part").agg(F.sum("_amount").alias("_sum"), F.count("*").alias("_n"), F.min("_left").alias("_left")))
        most = sums.groupBy(*by).agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= few:
            if most:
                taken.append(_one_by_one(open_, by).filter("_in").select("_nth"))
            break
        running = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        placed = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(running), F.lit(0)))
        over = F.col("_before") + F.col("_sum") > F.col("_left")
        stops = cut(placed.groupBy(*by).agg(F.min(F.when(over, F.struct("_part", "_before"))).alias("s"), F.sum("_sum").alias("_all"), F.min("_left").alias("_left")).select(*by, F.coalesce("s._part", F.lit(parts)).alias("_stop"), F.coalesce("s._before", "_all").alias("_spent"), F.col("_left").alias("_had")))
        named_stops = reduce(lambda df, b: df.withColumnRenamed(b, f"{b}_"), by, stops)
        met = open_.join(small(named_stops), same).drop(*[f"{b}_" for b in by])
        taken.append(cut(met.filter("_part < _stop").select("_nth")))
        inside = _one_by_one(met.filter("_part = _stop").withColumn("_left", F.col("_had") - F.col("_spent")), by)
        taken.append(inside.filter("_in").select("_nth"))
        ends = inside.groupBy(*by).agg(F.min("_after").alias("_after"))
        named_ends = reduce(lambda df, b: df.withColumnRenamed(b, f"{b}_"), by, ends)
        state = cut(stops.join(named_ends, same, "left").select(*by, F.coalesce("_after", F.col("_had") - F.col("_spent")).alias("_left"), (F.col("_stop") + 1).alias("_at")))
    if not taken:
        return whole.filter(F.lit(False)).select(*rows.columns)
    return whole.join(reduce(DataFrame.unionByName, taken), "_nth", "left_semi").select(*rows.columns)


def capped(df: DataFrame, amount: str, budget: float, keys: Sequence[str] = (), seed: int = 0, identity: Sequence[str] = (), parts: int = PARTS, few: int = FEW) -> DataFrame:
    """The rows of df that a greedy budget admits; with keys, each key has the budget for itself."""
    purses = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    return admitted(df, amount, purses.withColumn("budget", F.lit(float(budget))), keys, seed, identity, parts, few)


def shared_out(df: DataFrame, amount: str, budget: float, shares: Mapping[str, float], key: str, seed: int = 0, identity: Sequence[str] = (), parts: int = PARTS, few: int = FEW) -> DataFrame:
    """The rows of df that are admitted where each value of key has its share of the budget. The shares are of 1 in all and name
    every value there is."""
    if abs(sum(shares.values()) - 1.0) > 1e-6:
        raise ValueError(f"shares add up to {sum(shares.values())}, not to 1")
    purses = df.sparkSession.createDataFrame([(name, share * budget) for name, share in shares.items()], f"`{key}` string, budget double")
    nameless = df.select(key).distinct().join(purses, key, "left_anti").limit(10).collect()
    if nameless:
        raise ValueError(f"no share for {sorted(str(r[0]) for r in nameless)}")
    return admitted(df, amount, purses, [key], seed, identity, parts, few)
