"""Evaluation statistics with strict definitions: nearest-rank percentiles, AUC with averaged ties, concordance,
corpus word error rate, compliance and endpoint scores. All are aggregates that combine before the shuffle,
or windows over tables that have been aggregated first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import counted_before, nearest_ranks

#: Gates.
AUC_GATE, AUC_LEAST, TAG_GATE, FLAT = 0.80, 6, 0.98, 0.8
ENDPOINT_P50_MS, ENDPOINT_FALSE_CUTS = 235.0, 0.02
TAG_VERDICTS = ("ok", "missing", "malformed", "misplaced")


def nearest_rank(values: str, q: float) -> Column:
    """The value at rank ceil(q n) of the sorted values, never one between two. The distinct values of a group are held in
    one task: for few (clause lengths, whole milliseconds); ``ranks.nearest_ranks`` takes any number."""
    return F.expr(f"percentile_disc({q}D) WITHIN GROUP (ORDER BY {values})")


def latency(df: DataFrame, by: Sequence[str] = (), value: str = "latency_ms") -> DataFrame:
    """n, p50, p95 and worst; a mean is left out on purpose."""
    return nearest_ranks(df, by, value, {"p50": 0.5, "p95": 0.95, "worst": 1.0})


def auc(df: DataFrame, score: str, positive: str, by: Sequence[str] = (), least: int = 2) -> DataFrame:
    """Area under the curve from average ranks, per group: NaN with one class only.

    Rows are first counted by distinct score, and scores are ranked by ranges of them, so that neither the rows nor
    the scores of a group meet in one task."""
    counts = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("int")).alias("p"))
    ranked = counted_before(counts, by, [score], "n", "before")[1].withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)
    total = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("n_pos"), F.sum(F.col("rank") * F.col("p")).alias("r"))
    neg = F.col("n") - F.col("n_pos")
    area = (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / F.nullif(F.col("n_pos") * neg, F.lit(0))
    return total.filter(F.col("n") >= least).select(*by, "n", "n_pos", F.coalesce(area, F.lit(float("nan"))).alias("auc"))


def auc_summary(df: DataFrame, score: str, positive: str, by: str) -> DataFrame:
    """Mean, median, least and largest AUC of the groups that have enough rows and both classes, and the verdict."""
    each = auc(df, score, positive, [by], AUC_LEAST).filter(~F.isnan("auc"))
    return each.agg(F.count("*").alias("groups"), F.avg("auc").alias("mean"), F.median("auc").alias("median"), F.min("auc").alias("least"), F.max("auc").alias("largest")).withColumn("passed", F.coalesce(F.col("mean") > AUC_GATE, F.lit(False)))


def concordance(pred: str, true: str) -> Column:
    """Concordance correlation with population moments: 0 for fewer than two rows or no spread."""
    spread = F.var_pop(pred) + F.var_pop(true) + F.pow(F.avg(pred) - F.avg(true), 2)
    return F.when((F.count("*") < 2) | (spread == 0), 0.0).otherwise(2 * F.covar_pop(pred, true) / spread)


def corpus_wer(df: DataFrame, by: Sequence[str] = (), errors: str = "errors", words: str = "ref_words") -> DataFrame:
    """Sum of errors over sum of words, never a mean of rates; NaN without words."""
    rate = F.coalesce(F.sum(errors) / F.nullif(F.sum(words), F.lit(0)), F.lit(float("nan")))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(errors).alias("errors"), F.sum(words).alias("words"), rate.alias("wer"))


def worst(df: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The rows of the highest rate, ties by key."""
    return df.withColumn("rate", F.col("errors") / F.greatest(F.lit(1), F.col("ref_words"))).orderBy(F.desc("rate"), key).limit(most)


def filled(df: DataFrame, column: str, values: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """A grouped table with a row for each of the given values, 0 where there was none."""
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))
    return F.broadcast(every).join(df, column, "left").na.fill(0, list(counts))


def compliance(verdicts: DataFrame) -> DataFrame:
    """n, rate, passed and flat of rows (verdict, label)."""
    labels = verdicts.filter("label is not null").groupBy("label").agg(F.count("*").alias("c")).agg((F.max("c") / F.sum("c")).alias("top"))
    whole = verdicts.agg(F.count("*").alias("n"), F.avg((F.col("verdict") == "ok").cast("int")).alias("rate"))
    return whole.crossJoin(F.broadcast(labels)).select("n", F.round(F.coalesce("rate", F.lit(0.0)), 4).alias("rate"), ((F.col("n") > 0) & (F.coalesce("rate", F.lit(0.0)) >= TAG_GATE)).alias("passed"), F.coalesce(F.col("top") > FLAT, F.lit(False)).alias("flat"))


def endpoint(df: DataFrame, fired: str, ended: str, delay: str) -> DataFrame:
    """Delay percentiles of ends that were noticed, shares of false cuts and of missed ends, and the verdict."""
    f, e, none = F.col(fired), F.col(ended), F.lit(float("nan"))
    rows = df.select(F.when(f & e, F.col(delay)).alias("hit"), F.when(~e, f.cast("int")).alias("cut"), F.when(e, (~f).cast("int")).alias("miss"))
    shares = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("cut"), F.lit(0.0)).alias("false_cuts"), F.coalesce(F.avg("miss"), F.lit(0.0)).alias("missed"))
    delays = nearest_ranks(rows, [], "hit", {"p50": 0.5, "p90": 0.9}).drop("n")
    # One row and one row.
    scores = shares.crossJoin(F.broadcast(delays)).select("n", F.coalesce("p50", none).alias("p50"), F.coalesce("p90", none).alias("p90"), "false_cuts", "missed")
    return scores.withColumn("passed", ~F.isnan("p50") & (F.col("p50") <= ENDPOINT_P50_MS) & (F.col("false_cuts") <= ENDPOINT_FALSE_CUTS))


def sweep(df: DataFrame, score: str, positive: str, thresholds: Sequence[float], hop_seconds: float) -> DataFrame:
    """Recall and false accepts an hour at each threshold, in one pass: one pair of counters a threshold."""
    is_pos, s = F.col(positive), F.col(score)
    aggs = [F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(is_pos & (s >= t)).alias(f"tp{i}"), F.count_if(~is_pos & (s >= t)).alias(f"fp{i}")]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)])
    hours = F.greatest(F.col("neg") * hop_seconds / 3600, F.lit(1e-9))
    return df.agg(*aggs).select("pos", "neg", F.inline(rows)).select("threshold", (F.col("tp") / F.nullif(F.col("pos"), F.lit(0))).alias("recall"), (F.col("fp") / hours).alias("false_accepts_per_hour"))


def perplexity(nll: str, tokens: str) -> Column:
    """exp of the mean loss by token (at most 20), null without tokens."""
    return F.exp(F.least(F.sum(nll) / F.nullif(F.sum(tokens), F.lit(0)), F.lit(20.0)))


def round_up(value: Column, step: int = 64) -> Column:
    return (F.ceil(value / step) * step).cast("long")


def by_clause(runs: DataFrame, words: str, ttfa: str, seconds: str) -> DataFrame:
    """Times to first audio by length of the clause: n, p50, p95 and the median length of the audio."""
    rows = runs.select(words, ttfa, F.col(seconds).cast("double").alias("_up"), (-F.col(seconds).cast("double")).alias("_down"))
    counts = rows.groupBy(words).agg(F.count("*").alias("n"))
    # The median is the mean of the two middle values: the nearest rank from below and from above.
    told = [nearest_ranks(rows, [words], ttfa, {"p50": 0.5, "p95": 0.95}), nearest_ranks(rows, [words], "_up", {"_low": 0.5}), nearest_ranks(rows, [words], "_down", {"_high": 0.5})]
    for part in told:
        named = part.drop("n").withColumnRenamed(words, "_words")
        counts = counts.join(named, F.col(words).eqNullSafe(F.col("_words")), "left").drop("_words")
    return counts.select(words, "n", "p50", "p95", ((F.col("_low") - F.col("_high")) / 2).alias("audio_s"))


def longest_within(clauses: DataFrame, budget_ms: float, by: Sequence[str] = ()) -> DataFrame:
    """Whether the longest clause meets the budget, which is what decides."""
    return clauses.groupBy(*by).agg(F.max_by("p50", "words").alias("p50")).withColumn("passed", F.col("p50") < budget_ms)


def call_rates(checks: DataFrame, check: str = "check") -> DataFrame:
    """Shares of well-formed and of known calls, and the first three replies that were not well-formed."""
    rates = checks.agg(F.avg(F.col(f"{check}.well_formed").cast("int")).alias("well_formed"), F.avg(F.col(f"{check}.known").cast("int")).alias("known"))
    first = checks.filter(~F.col(f"{check}.well_formed") & F.col("reply").isNotNull()).select("reply").distinct().orderBy("reply").limit(3)
    # One row and one row.
    return rates.crossJoin(first.agg(F.array_sort(F.collect_list("reply")).alias("examples")))
