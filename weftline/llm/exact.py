"""Exact deduplication by skew-safe combining.

Texts go through three stages, and in each the whole text is compared, as a grouping key beside its digest:

1. local: every task reduces its own rows to one per text (the partial aggregate before the shuffle);
2. salted: the local winners of a digest meet in ``SALTS`` groups, by the task they come from, so that a text with copies
   in every task is not one group of as many rows;
3. global: at most ``SALTS`` salt winners of a text are combined, for its count and its largest doc_id.

The verdict goes back the same way, without texts: rows of (doc_id, digest) are counted by digest and salt, each such part
takes the verdict of its digest, and each row that of its part, so no key holds more than a salt's share of a group. Where two
texts share a digest (``digest`` can be any column function), the digest does not name a text: rows of such digests get
a number by their text first, joined on digest and text.

Defined results: a null text counts as an empty one; the row of the largest doc_id stays, a null doc_id comes before
all others; of rows equal in text and doc_id one stays, and it is the same one for the whole result; texts of any length are
compared whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SALTS = 32


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def combined(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """digest, text, keep_id and n of every distinct text of rows (digest, text, doc_id)."""
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))
    )
    return salted.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("n"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """doc_id, digest, keep_id (doc_id of the row that stays), group_size and kept of every row of docs."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", digest(F.col("text")).alias("digest"))
    groups = cut(combined(rows, salts).select("digest", F.lit(0).alias("nth_text"), "keep_id", "n"))
    # Digests that more than one text has: hardly ever any, and then their texts are looked at again.
    shared = cut(groups.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"))
    numbered = rows.select("doc_id", "digest", F.lit(0).alias("nth_text"))
    if not shared.isEmpty():
        several = combined(rows.join(shared, "digest", "left_semi"), salts)
        several = cut(several.withColumn("nth_text", F.row_number().over(Window.partitionBy("digest").orderBy("text"))))
        groups = groups.join(shared, "digest", "left_anti").unionByName(several.drop("text"))
        again = rows.join(shared, "digest", "left_semi").join(several.select("digest", "text", "nth_text"), ["digest", "text"])
        numbered = numbered.join(shared, "digest", "left_anti").unionByName(again.select("doc_id", "digest", "nth_text"))
    # Written once: rows are told apart by where they are in this table.
    narrow = cut(numbered.withColumn("nth", F.monotonically_increasing_id())).withColumn("salt", F.pmod("nth", F.lit(salts)).cast("int"))
    name = ["digest", "nth_text"]
    parts = narrow.groupBy(*name, "salt").agg(F.max(F.struct("doc_id", "nth")).alias("last"))
    winner = parts.groupBy(*name).agg(F.max("last.doc_id").alias("check_id"), F.max("last")["nth"].alias("keep_nth"))
    verdicts = groups.join(winner, name).select(*name, "keep_id", "n", "keep_nth")
    by_part = parts.select(*name, "salt").join(verdicts, name)
    return narrow.join(by_part, [*name, "salt"]).select("doc_id", "digest", "keep_id", F.col("n").alias("group_size"), (F.col("nth") == F.col("keep_nth")).alias("kept"))


def kept(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each text, that of the largest doc_id."""
    place = F.struct("doc_id", F.monotonically_increasing_id().alias("nth")).alias("place")
    rows = docs.select(F.struct("*").alias("row"), place, F.coalesce("text", F.lit("")).alias("whole"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    local = rows.groupBy("whole", "salt").agg(F.max_by("row", "place").alias("row"), F.max("place").alias("place"))
    return local.groupBy("whole").agg(F.max_by("row", "place").alias("row")).select("row.*")
