"""Preparation of a text corpus in one pass: licence gate, caps, drops, dedup across sources, split and files, with a receipt.

The whole is one plan that is written: every row is read and cleaned once, equal texts are combined before they are shuffled, and
what was dropped on the way is counted by observations of that same job, not by jobs of their own. Counts by source, reason and
language are expressions over lists that are known ahead (the manifest, the rules, the languages), so a receipt has a bounded
size; a language that is not listed counts as ``other``.

Of equal texts the one of the first source (by priority, then name) stays, and in it the first in reader order. The side of the
split depends on the text alone. Should a stage run again after the loss of an executor, Spark may observe its rows twice; then the
receipt's ``checked`` is false, as the rows written are counted again from the files where that is asked for."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import write_text
from .corpus import capped_by_source, licence_status, verdict


class LicenceRefused(ValueError):
    """A source was asked for by name whose licence forbids the use."""


@dataclass
class Plan:
    """Which sources are read, in their order, and why others are not."""

    included: list[str] = field(default_factory=list)
    refused: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    unreadable: list[str] = field(default_factory=list)
    licence: dict[str, str] = field(default_factory=dict)
    publishable: dict[str, bool] = field(default_factory=dict)
    adapter: str = "yes"


def plan(manifest: DataFrame, readable: Sequence[str], complete: Column, only: Sequence[str] | None = None, publishable_only: bool = False) -> Plan:
    """manifest: name, license, flags, weights_publishable and priority, a table written by hand."""
    status = licence_status(manifest, readable, complete, publishable_only)
    rows = status.orderBy("priority", "name").collect()
    unknown = set(only or ()) - {r["name"] for r in rows}
    if unknown:
        raise KeyError(f"not in the manifest: {sorted(unknown)}")
    out = Plan()
    for r in rows:
        if only is None or r["name"] in only:
            getattr(out, r["status"]).append(r["name"])
            out.licence[r["name"]], out.publishable[r["name"]] = r["license"], r["weights_publishable"] == "yes"
    if only and out.refused:
        raise LicenceRefused(f"refused by licence: {out.refused}")
    out.adapter = manifest.filter(F.col("name").isin(out.included)).agg(verdict().alias("v")).first()["v"]
    return out


def _count(name: str, condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def prepare(
    rows: DataFrame, chosen: Plan, out: str, order: Sequence[str], caps: Mapping[str, int] | None = None, rules: Sequence[tuple[str, Column]] = (), langs: Sequence[str] = (), seed: int = 0, fraction: float = 0.05, check: bool = False,
) -> dict:
    """Writes rows (source, lang, text, the order columns and any others) as JSON lines into out/split=train and out/split=val, and
    out/stats.json, and returns what that holds. order tells the rows of a source apart, in reader order. Rows without text after
    cleaning are dropped as ``blank``, others by the first of rules (a name and a condition on the cleaned rows) that holds."""
    sources, spark = chosen.included, rows.sparkSession
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]).cast("array<string>"), F.col("source"))
    read = capped_by_source(rows.filter(F.col("source").isin(sources)), "source", list(order), dict(caps or {}))
    clean = read.withColumn("text", tx.clean(F.col("text")))
    reason = F.when(F.col("text") == "", "blank")
    for name, rule in rules:
        reason = reason.when(rule, name)
    names = ["blank", *[name for name, _ in rules]]
    before, after = Observation(), Observation()
    of = lambda i: F.col("source") == sources[i]
    each = range(len(sources))
    # Observed rows are a border that filters do not cross: each text is cleaned once.
    marked = clean.withColumn("_drop", F.coalesce(reason, F.lit("")))
    seen = marked.observe(before, F.count("*").alias("all"), *[_count(f"{i} {name}", of(i) & (F.col("_drop") == name)) for i in each for name in ["", *names]])
    place = F.struct(rank.alias("rank"), *order)
    first = seen.filter("_drop = ''").drop("_drop").groupBy(F.sha2("text", 256).alias("_digest")).agg(F.min_by(F.struct(*rows.columns), place).alias("_row")).select("_row.*")
    sided = first.withColumn("split", tx.split_side(F.col("text"), seed, fraction))
    measures = {"train": F.col("split") == "train", "val": F.col("split") == "val", **{f"lang {x}": F.col("lang") == x for x in langs}, "lang other": ~F.coalesce(F.col("lang").isin(list(langs)), F.lit(False))}
    told = sided.observe(after, F.count("*").alias("all"), *[_count(f"{i} {name}", of(i) & m) for i in each for name, m in measures.items()])
    told.write.mode("overwrite").partitionBy("split").json(out)
    b, a = before.get, after.get
    stats: dict = {"seed": seed, "val_fraction": fraction, "sources": {}, "refused": chosen.refused, "missing": chosen.missing, "unreadable": chosen.unreadable, "publishable": chosen.adapter}
    for i, name in enumerate(sources):
        n = a[f"{i} train"] + a[f"{i} val"]
        stats["sources"][name] = {
            "n": n, "train": a[f"{i} train"], "val": a[f"{i} val"], "duplicates": b[f"{i} "] - n, "dropped": {x: b[f"{i} {x}"] for x in names if b[f"{i} {x}"]},
            "lang": {x: a[f"{i} lang {x}"] for x in [*langs, "other"] if a[f"{i} lang {x}"]}, "licence": chosen.licence[name], "publishable": chosen.publishable[name],
        }
    stats["totals"] = {"read": b["all"], "n": a["all"], **{x: sum(s[x] for s in stats["sources"].values()) for x in ("train", "val", "duplicates")}}
    if check:
        stats["checked"] = spark.read.schema("split string").json(out).count() == a["all"]
    write_text(spark, f"{out.rstrip('/')}/stats.json", json.dumps(stats, indent=1, ensure_ascii=False) + "\n")
    return stats
