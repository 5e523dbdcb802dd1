"""Operators on conversations: merging, trimming, histories, and pairing of tool results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """df with the number of the run of equal values that each row of a key is in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def merge_turns(df: DataFrame, keys: list[str], order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Consecutive turns of one role as one turn, texts joined by a space in order; blank turns drop out first."""
    spoken = df.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    return (
        runs(spoken, keys, [order], role)
        .groupBy(*keys, "run", role)
        .agg(F.min(order).alias(order), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda t: t[text]), " ").alias(text), F.count("*").alias("turns"))
    )


def trim_to_answer(df: DataFrame, keys: list[str], order: str, role: str = "role", answer: str = "assistant", least: int = 2) -> DataFrame:
    """Turns up to the last answer of each conversation that still has the least number of turns."""
    w = Window.partitionBy(*keys)
    last = F.max(F.when(F.col(role) == answer, F.col(order))).over(w)
    return df.withColumn("_last", last).filter(F.col(order) <= F.col("_last")).withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least).drop("_last", "_n")


def finish(messages: Column, least: int = 2) -> Column:
    """The same on an array of structs with role: null if too few are left."""
    last = F.size(messages) - F.array_position(F.reverse(F.transform(messages, lambda m: m["role"] == "assistant")), True) + 1
    has = F.exists(messages, lambda m: m["role"] == "assistant")
    return F.when(has & (last >= least), F.slice(messages, F.lit(1), last.cast("int")))


def last_exchanges(df: DataFrame, keys: list[str], order: str, most: int, role: str = "role", opens: str = "user") -> DataFrame:
    """The turns of the last exchanges of each conversation; an exchange begins at a turn of the opening role."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = df.withColumn("exchange", F.sum(F.when(F.col(role) == opens, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("_all", F.max("exchange").over(Window.partitionBy(*keys))).filter(F.col("exchange") > F.col("_all") - most).drop("_all")


def pair_results(calls: DataFrame, results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The n-th result of a conversation answers its n-th call: calls with result (null while unanswered)."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return calls.withColumn("ordinal", number).join(results.withColumn("ordinal", number).select(*keys, "ordinal", F.col("content").alias("result")), [*keys, "ordinal"], "left")


def first_call_turn(messages: Column) -> Column:
    """Index from 0 of the first assistant message with tool calls, or null."""
    at = F.array_position(F.transform(messages, lambda m: (m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)), True)
    return F.when(at > 0, at - 1)
