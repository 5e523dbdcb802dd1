"""Running totals, row numbers and percentiles over groups of any size.

A window over a group puts the group into one task. Here rows are dealt by ranges of (group, order); each range is added up by
itself, and what comes before a range is a running sum over one row a range and group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut


#: Rows of a report (a table counted by its values) up to which one window does.
FEW = 100_000


def total_before(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """df with ``out``: the sum of value over the rows of the same group (columns by) that come before, in the order of
    columns that tell its rows apart."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_v", value.cast("long")).repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id())
    # Ranges come from a sample, which another run need not repeat: they are written once.
    dealt = cut(dealt)
    sums = dealt.groupBy(*by, "_part").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_inside", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return summed.join(offsets, same).select(*df.columns, (F.col("_inside") + F.col("_offset")).alias(out))


def counted_before(counts: DataFrame, by: Sequence[str], order: Sequence[str], n: str, out: str, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """A table counted by its values, computed once, and the same with ``out``: total_before of the column n. A table of at most
    ``few`` rows in all is summed up in plain windows."""
    kept = cut(counts)
    if kept.count() > few:
        return kept, total_before(kept, by, order, F.col(n), out)
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return kept, kept.withColumn(out, F.coalesce(F.sum(F.col(n).cast("long")).over(before), F.lit(0).cast("long")))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """df with ``out``: 0, 1, ... in the order of columns that tell the rows of a group apart."""
    return total_before(df, by, order, F.lit(1), out)


def nearest_ranks(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float], few: int = FEW) -> DataFrame:
    """For each group the values at rank ceil(q n) of its sorted values that are not null, under the names wanted, and n.
    Equal values are counted first, so a group may have any number of rows and of values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    counts, placed = counted_before(counts, by, [value], "_n", "_before", few)
    totals = counts.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.sum("_n").alias("n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    joined = placed.join(totals if by else F.broadcast(totals), same)
    hit = lambda q: F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)).between(F.col("_before") + 1, F.col("_before") + F.col("_n"))
    return joined.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(hit(q), F.col(value))).alias(name) for name, q in wanted.items()])
