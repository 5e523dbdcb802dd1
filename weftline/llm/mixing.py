"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies: its source's target spread over its documents by a
weight that falls with the size class (documents beyond ``LONG`` words count less, so that no few
giants make up a source), at most ``MOST`` each. The whole part is taken for certain. The rest is an
inclusion probability p, and the documents of a source are ranked by (u/(1-u)) / (p/(1-p)) with u in (0, 1) a
hash of doc_id, text and, where a source has both more than once, the number of the copy, so that null or repeated ids are
ranked each by itself; the first in that order are taken until the words still missing are
reached, to the nearest document, and where that leaves a gap, one more document of the source closes
it: of those ranked after, the one whose size is nearest to the gap. So the sample has a fixed size in words, reruns agree, and no
source is ranked in one task: ranks are dealt into ``BUCKETS`` intervals, words are summed by interval,
and only the interval in which the target falls is looked at document by document.

Defined results: a null text has size 0; sources sort by code point, null last; documents of size 0 are
taken 0 words; rows of null or equal doc_id are ranked by their texts, too, and rows equal in source, doc_id and text by a
number of their own, so that of such rows as many are taken as the target asks for (which ones is not told); a text of any
length is counted whole; an empty table gives no rows; weights cycle over the sources; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small, word_count
from .sharding import number

#: Fixed values of the mix: the cycle of weights, the share of all words, the most copies of a document.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
LONG = 1024
#: Intervals of the rank; the odds ratio q is mapped to (0, 1) by q / (1 + q).
BUCKETS = 4096
#: The order in which the documents of a source are taken.
KEY = ("mix_q", "doc_id", "mix_size", "mix_digest", "mix_copy")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from one row (source, source_size) for each source.

    Shares go by weight; a source stops at ``most`` times its size and what is left over is shared again by
    weight. In the order of size/weight, the sources that stop come first, so one running sum finds them.
    The windows run over the sources, a handful of rows, not over documents."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    first = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    onward = first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("ratio", most * F.col("source_size") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("level", (share * F.col("all_words") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("stops", F.col("level") >= F.col("ratio"))
        .withColumn("final", F.min(F.when(~F.col("stops"), F.struct("ratio", "level"))).over(everything)["level"])
        .select("source", "source_size", F.when(F.col("stops"), most * F.col("source_size")).otherwise(F.col("final") * F.col("weight")).cast("double").alias("target"))
    )


def uniform(doc_id: Column, seed: str, digest: Column, copy: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash of doc_id, the digest of the text and the number of the copy, the same on any
    engine."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(seed), digest, copy.cast("string"))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + 0.5) / float(16**13)


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


#: What tells the rows of a source apart, beside the number of the copy.
_SELF = ["source", "doc_id", "mix_digest"]


def _copies(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """rows with mix_copy: 0 where no other row is equal in _SELF, else 0, 1, ... in each such group. A group is numbered in
    parts, so it may hold any share of the rows."""
    if repeated is None:
        return rows.withColumn("mix_copy", F.lit(0).cast("long"))
    named = repeated.select(*[F.col(c).alias(f"r_{i}") for i, c in enumerate(_SELF)], F.lit(True).alias("r_many"))
    at = _same(F.col("source"), F.col("r_0")) & _same(F.col("doc_id"), F.col("r_1")) & (F.col("mix_digest") == F.col("r_2"))
    joined = rows.join(named, at, "left").drop("r_0", "r_1", "r_2")
    group = F.concat_ws(":", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "mix_digest")
    # The rows of such groups are written once and told apart by where they are in that table.
    many = cut(joined.filter("r_many").drop("r_many").withColumns({"mix_group": group, "mix_row": F.monotonically_increasing_id()}))
    many = number(many, ["mix_group"], ["mix_row"]).withColumnRenamed("slot", "mix_copy").drop("mix_group", "mix_row")
    return many.unionByName(joined.filter("r_many is null").drop("r_many").withColumn("mix_copy", F.lit(0).cast("long")))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(docs: DataFrame, seed: str = "mix", most: float = MOST, buckets: int = BUCKETS) -> DataFrame:
    """row (a struct of all columns of docs, whatever their names), size, source_size, target and copies (0 to
    most) for every row of docs."""
    # Long documents count less, by half steps of the size class.
    klass = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.col("mix_size"), F.lit(1)) / float(LONG)))).cast("int")
    narrow = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("mix_size"), _digest().alias("mix_digest")))
    repeated = small(narrow.groupBy(*_SELF).agg(F.count("*").alias("n")).filter("n > 1"))
    repeated = None if repeated.isEmpty() else repeated
    classes = small(narrow.groupBy("source", klass.alias("klass")).agg(F.sum("mix_size").alias("words")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), most=most)
    # Expected copies of a class: min(most, alpha * weight), with alpha such that the words add up to the target.
    rising = Window.partitionBy("t_source").orderBy(F.col("klass"))
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.pow(F.lit(2.0), -0.5 * F.col("klass"))
    plan = small(
        targets.withColumnRenamed("source", "t_source").join(classes.withColumnRenamed("source", "c_source"), _same(F.col("t_source"), F.col("c_source")))
        .withColumn("alpha", (F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.nullif(F.sum(F.col("words") * weight).over(after), F.lit(0.0)))
        .withColumn("full", F.coalesce(F.col("alpha") * weight >= most, F.lit(False)) | (F.col("target") >= most * F.col("source_size")))
        .withColumn("alpha_end", F.coalesce(F.min(F.when(~F.col("full"), F.struct("klass", "alpha"))).over(Window.partitionBy("t_source"))["alpha"], F.lit(0.0)))
        .withColumn("expected", F.when(F.col("full"), F.lit(float(most))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col("alpha_end") * weight))))
        .withColumn("sure", F.floor("expected").cast("int"))
        .withColumn("p", F.col("expected") - F.col("sure"))
        .withColumn("missing", F.col("target") - F.sum(F.col("words") * F.col("sure")).over(Window.partitionBy("t_source")))
        .select(F.col("t_source"), F.col("klass").alias("t_klass"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "sure", "p", "missing")
    )

    def ranked(df: DataFrame) -> DataFrame:
        u = uniform(F.col("doc_id"), seed, F.col("mix_digest"), F.col("mix_copy"))
        odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
        return (
            df.withColumn("mix_klass", klass)
            .join(plan, _same(F.col("source"), F.col("t_source")) & (F.col("mix_klass") == F.col("t_klass")), "left")
            .withColumn("mix_q", F.when(F.col("p") > 0, odds))
            .withColumn("mix_bucket", F.when(F.col("p") > 0, F.least(F.lit(buckets - 1), F.floor(F.lit(buckets) * F.col("mix_q") / (1 + F.col("mix_q"))).cast("int"))))
        )

    # Where the missing words run out: first by interval, then by document inside that interval.
    light = cut(ranked(_copies(narrow, repeated)).filter("p > 0").select("doc_id", "source", "mix_size", "mix_digest", "mix_copy", "mix_q", "mix_bucket", "missing"))
    by_bucket = light.groupBy("source", "mix_bucket").agg(F.sum("mix_size").alias("words"), F.min("missing").alias("missing"))
    run = Window.partitionBy("source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = small(
        by_bucket.withColumn("start", F.coalesce(F.sum("words").over(run), F.lit(0)))
        .filter("start < missing and start + words >= missing")
        .groupBy("source").agg(F.min(F.struct("mix_bucket", "start", "missing")).alias("e"))
        .select(F.col("source").alias("e_source"), F.col("e.mix_bucket").alias("e_bucket"), F.col("e.start").alias("e_start"), F.col("e.missing").alias("e_missing"))
    )
    at = _same(F.col("source"), F.col("e_source")) & (F.col("mix_bucket") == F.col("e_bucket"))
    inside = Window.partitionBy("source").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct(*KEY)
    reached = light.join(edge, at).withColumn("reach", F.col("e_start") + F.sum("mix_size").over(inside))
    # The last document of the prefix that stays below the missing words.
    last = (
        reached.filter(F.col("reach") <= F.col("e_missing"))
        .groupBy("source").agg(F.max(F.struct(key.alias("key"), "reach")).alias("l"))
        .select(F.col("source").alias("l_source"), F.col("l.key").alias("l"), F.col("l.reach").alias("l_reach"))
    )
    prefix = edge.join(last, _same(F.col("e_source"), F.col("l_source")), "left").select("e_source", "e_bucket", "l", (F.col("e_missing") - F.coalesce("l_reach", "e_start")).alias("gap"))
    prefix = small(prefix)
    later = (F.col("mix_bucket") > F.col("e_bucket")) | ((F.col("mix_bucket") == F.col("e_bucket")) & F.coalesce(key > F.col("l"), F.lit(True)))
    # The closing document: nearest in size to the gap, if that is nearer than none.
    closing = (
        light.join(prefix, _same(F.col("source"), F.col("e_source"))).filter(later)
        .withColumn("off", F.abs(F.col("mix_size") - F.col("gap"))).filter(F.col("off") < F.col("gap"))
        .groupBy("source").agg(F.min(F.struct("off", key.alias("key"))).alias("c"))
        .select(F.col("source").alias("c_source"), F.col("c.key").alias("c"))
    )
    ends = small(prefix.join(closing, _same(F.col("e_source"), F.col("c_source")), "left").select("e_source", "e_bucket", "l", "c"))
    # Without an edge all that is ranked is needed, if any words are missing.
    chosen = F.when(F.col("e_bucket").isNull(), F.col("missing") > 0).otherwise(~later | F.coalesce(key == F.col("c"), F.lit(False)))
    extra = F.when(F.col("p") > 0, chosen)
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("mix_size"), _digest().alias("mix_digest"))
    out = ranked(_copies(whole, repeated)).join(ends, _same(F.col("source"), F.col("e_source")), "left")
    copies = F.coalesce(F.col("sure"), F.lit(0)) + F.coalesce(extra.cast("int"), F.lit(0))
    return out.select("row", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), copies.alias("copies"))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    return mix(docs, seed).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
