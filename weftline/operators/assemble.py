"""Putting parts together: streamed fragments, blocks of lines, matched pairs, intervals and rings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import numbered


def joined_calls(deltas: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Calls from fragments (index, name, arguments): arguments are joined in order, the first name counts; calls
    without a name or with arguments that are no JSON object drop out."""
    parts = F.array_sort(F.collect_list(F.struct(order, "name", "arguments")))
    whole = deltas.groupBy(*keys, "index").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.coalesce(p["arguments"], F.lit(""))), "")
    name = F.try_element_at(F.filter(F.transform("parts", lambda p: p["name"]), lambda n: n.isNotNull() & (n != "")), F.lit(1))
    made = whole.select(*keys, "index", name.alias("name"), F.when(F.trim(text) == "", "{}").otherwise(text).alias("arguments"))
    return made.filter(F.col("name").isNotNull() & F.json_object_keys("arguments").isNotNull())


def blocks(lines: DataFrame, keys: Sequence[str], order: str, header: str, fields: dict[str, str]) -> DataFrame:
    """Rows of text blocks that each begin with a header line: block, head (the header's first group) and the first
    group of each field's pattern within the block."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("block", F.sum(F.col("line").rlike(header).cast("int")).over(w)).filter("block > 0")
    first = lambda pattern: F.max(F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1)))
    return numbered.groupBy(*keys, "block").agg(first(header).alias("head"), *[first(p).alias(name) for name, p in fields.items()])


def matched_pairs(rows: DataFrame, pair: str, order: str, reply: Column) -> DataFrame:
    """Pairs of rows that share a key, and whether their replies differ; keys without exactly two rows drop out."""
    both = rows.filter(F.col(pair).isNotNull()).groupBy(pair).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.lower(F.trim(reply)).alias("reply")))).alias("two"))
    return both.filter(F.size("two") == 2).select(pair, (F.col("two")[0]["reply"] != F.col("two")[1]["reply"]).alias("differ"))


def positions(table: DataFrame, asked: DataFrame, index: str = "index") -> DataFrame:
    """asked with the row of that place in table (columns index, value), or the reason why there is none."""
    n = table.count()
    reason = F.when(F.col(index) < 0, "negative").when(F.col(index) >= n, "beyond the end")
    return asked.withColumn("reason", reason).join(table, index, "left")


def inside(windows: DataFrame, start: str, end: str, begin: float, stop: float) -> DataFrame:
    """windows with a label: 1 where a window ends within an interval and began in or after it."""
    return windows.withColumn("label", ((F.col(end) >= stop) & (F.col(start) <= begin)).cast("int"))


def recent(events: DataFrame, keys: Sequence[str], at: str, seconds: float, value: str) -> DataFrame:
    """events with the values of the last seconds before each, itself included: a ring that is never padded."""
    by = ", ".join(f"`{k}`" for k in keys)
    return events.withColumn("recent", F.expr(f"collect_list(`{value}`) OVER (PARTITION BY {by} ORDER BY `{at}` RANGE BETWEEN {float(seconds)}D PRECEDING AND CURRENT ROW)"))


def hard_negatives(scored: DataFrame, score: str, positive: str, least: float = 0.5, weight: float = 8.0) -> DataFrame:
    """scored with a weight: negatives that were taken for positives weigh more."""
    return scored.withColumn("weight", F.when(~F.col(positive) & (F.col(score) >= least), F.lit(weight)).otherwise(F.lit(1.0)))


def windows_ahead(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int, block: int = 10_000) -> DataFrame:
    """keys, order and window: the values of each row and the next ones, size in all; rows with fewer behind them are left out.

    A key of any length is cut into blocks of rows, and a block gets the first rows of the next one as well, so that every window
    is whole in a block and no task holds a key."""
    if not 0 < size <= block:
        raise ValueError("a window is at most a block long")
    placed = numbered(df.select(*dict.fromkeys([*keys, *order, value])), keys, order, "_n")
    own = F.floor(F.col("_n") / block)
    both = F.when((F.col("_n") % block < size - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    ahead = Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(0, size - 1)
    found = placed.withColumn("_own", own).withColumn("_block", F.explode(both)).withColumn("window", F.collect_list(value).over(ahead))
    return found.filter((F.col("_own") == F.col("_block")) & (F.size("window") == size)).select(*keys, *order, "window")
