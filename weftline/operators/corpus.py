"""Corpus preparation: dedup across sources, caps, splits, accounts, licences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.shared import cut

#: Flags under which weights can't be released; verdicts from open to closed.
CLOSED_FLAGS = ("NC", "ND", "research-only")
VERDICTS = ("yes", "unclear", "no")


def canonical(messages: Column, tools: Column) -> Column:
    """The key of a record: JSON of messages and tools with sorted keys, nothing else."""
    return F.to_json(F.struct(messages.alias("messages"), tools.alias("tools")))


def capped_by_source(df: DataFrame, source: str, order: Sequence[str], caps: dict[str, int] | int) -> DataFrame:
    """The first rows of each source in reader order, before any dedup. A cap is small; the ranking keeps no more
    than that many rows of a source per partition."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    if isinstance(caps, int):
        return df.withColumn("_r", rank).filter(F.col("_r") <= caps).drop("_r")
    if not caps:
        return df
    limit = F.lit(0)
    for name, n in caps.items():
        limit = F.when(F.col(source) == name, n).otherwise(limit)
    # Only sources with a cap are ranked, and no more of each than the largest cap.
    with_cap = F.coalesce(F.col(source).isin(*caps), F.lit(False))
    first = df.filter(with_cap).withColumn("_r", rank).filter(F.col("_r") <= max(caps.values())).filter(F.col("_r") <= limit).drop("_r")
    return first.unionByName(df.filter(~with_cap))


def first_of_each(df: DataFrame, digest: str, order: Sequence[str], flag: str = "is_first") -> DataFrame:
    """df with a flag for the first row of each digest in order.

    The least place of each digest is a minimum that combines before the shuffle; a digest of very many rows is
    left to the skew splitting of the join. Places must tell the rows of a table apart."""
    least = df.groupBy(digest).agg(F.min(F.struct(*order)).alias("_least"))
    return df.join(least, digest).withColumn(flag, F.struct(*order) == F.col("_least")).drop("_least")


def with_split(df: DataFrame, key: Column, seed: int = 0, fraction: float = 0.05) -> DataFrame:
    return df.withColumn("split", tx.split_side(key, seed, fraction))


def accounts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts by each dimension and in all, in one pass."""
    sets = [[d] for d in dims] + [[]]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims]).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, source rank (the number in the name), digest of the cleaned text, whether it is blank, and
    split. Texts are read and cleaned here, in one projection, and only what is narrow goes on; a filter on any of these
    columns belongs behind a shuffle or a cut, or each text is cleaned again for it."""
    text = docs.select("doc_id", "source", "lang", tx.clean(F.col("text")).alias("text"))
    rank = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return with_split(text, F.col("text")).select("doc_id", "source", "lang", rank.alias("src_rank"), F.sha2("text", 256).alias("digest"), (F.col("text") == "").alias("blank"), "split")


def prepared(docs: DataFrame) -> DataFrame:
    """Cleaned documents with text, and the flag of the first copy."""
    return first_of_each(cut(cleaned(docs)).filter("not blank").drop("blank"), "digest", ["src_rank", "doc_id"])


def prep_accounts(docs: DataFrame) -> DataFrame:
    """Rows kept, duplicates, train and val rows by source and language.

    Copies are counted by text, source and language before texts meet, so a text of any number of copies has a row for
    each source and language at most, and no rows are joined. Equal texts have equal splits."""
    keys = ["source", "lang"]
    copies = cleaned(docs).groupBy("digest", *keys).agg(
        F.count("*").alias("rows"), F.min(F.struct("src_rank", "doc_id")).alias("place"), F.first("split").alias("split"), F.first("blank").alias("blank")
    )
    first = F.when(F.col("place") == F.min("place").over(Window.partitionBy("digest")), 1).otherwise(0)
    one = copies.filter("not blank").withColumn("first", first)
    side = lambda name: F.sum(F.when(F.col("split") == name, F.col("first")).otherwise(0))
    return one.groupBy(*keys).agg(F.sum("first").alias("n"), F.sum(F.col("rows") - F.col("first")).alias("duplicates"), side("train").alias("train"), side("val").alias("val"))


def refusal(flags: Column) -> Column:
    """The flags that forbid a release, sorted; null if there are none."""
    bad = F.array_sort(F.array_intersect(flags, F.array(*map(F.lit, CLOSED_FLAGS))))
    return F.when(F.size(bad) > 0, F.array_join(bad, ","))


def licence_status(manifest: DataFrame, readable: Sequence[str], complete: Column, publishable_only: bool = False) -> DataFrame:
    """status of each manifest row: unreadable, refused, missing or included, in this order."""
    refused = refusal(F.col("flags")).isNotNull()
    if publishable_only:
        refused = refused | (F.col("weights_publishable") != "yes")
    status = F.when(~F.col("name").isin(*readable), "unreadable").when(refused, "refused").when(~complete, "missing").otherwise("included")
    return manifest.withColumn("status", status)


def verdict(publishable: str = "weights_publishable") -> Column:
    """The most closed verdict of a group: what is not known is unclear, and no row at all is yes."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, VERDICTS)), F.coalesce(publishable, F.lit("unclear"))), F.lit(2))
    return F.element_at(F.array(*map(F.lit, VERDICTS)), F.coalesce(F.max(rank), F.lit(1)).cast("int"))


def licensed(df: DataFrame, manifest: DataFrame, key: str = "source") -> DataFrame:
    """df with licence and weights_publishable of its source; unknown and unclear without an entry. The manifest is
    a hand-written table of some dozens of rows; Spark broadcasts it by its size."""
    entry = manifest.select(F.col("name").alias(key), F.col("license").alias("licence"), "weights_publishable")
    return df.join(entry, key, "left").na.fill({"licence": "unknown", "weights_publishable": "unclear"})


def publishable(df: DataFrame, manifest: DataFrame, key: str = "source") -> DataFrame:
    """Rows whose source may be published; without an entry they go."""
    return df.join(manifest.filter("weights_publishable = 'yes'").select(F.col("name").alias(key)), key, "left_semi")


def skip_reasons(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "skip_reason") -> DataFrame:
    """df with the first reason whose rule holds, or null. The order of the rules is part of their meaning."""
    reason = F.lit(None).cast("string")
    for label, rule in reversed(rules):
        reason = F.when(F.coalesce(rule, F.lit(False)), label).otherwise(reason)
    return df.withColumn(name, reason)
