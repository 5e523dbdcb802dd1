"""The preparation as a whole: gate, caps, drops, dedup, split, files and receipt, against the plain loop."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import prep

MANIFEST = [
    ("b-first", "MIT", [], "yes", 1), ("a-second", "CC0", [], "yes", 2), ("c-unclear", "odd", [], "unclear", 2), ("d-closed", "NC", ["NC"], "no", 1), ("e-gone", "MIT", [], "yes", 3), ("f-odd", "MIT", [], "yes", 3),
]
READABLE = [m[0] for m in MANIFEST if m[0] != "f-odd"]


def manifest(spark):
    return spark.createDataFrame(MANIFEST, "name string, license string, flags array<string>, weights_publishable string, priority int")


def plan(spark, **more):
    return prep.plan(manifest(spark), READABLE, F.col("name") != "e-gone", **more)


def test_the_licence_gate(spark):
    p = plan(spark)
    assert (p.included, p.refused, p.missing, p.unreadable, p.adapter) == (["b-first", "a-second", "c-unclear"], ["d-closed"], ["e-gone"], ["f-odd"], "unclear")
    assert plan(spark, publishable_only=True).included == ["b-first", "a-second"] and plan(spark, publishable_only=True).adapter == "yes"
    assert plan(spark, only=["a-second"]).included == ["a-second"]
    with pytest.raises(prep.LicenceRefused):
        plan(spark, only=["d-closed"])
    with pytest.raises(KeyError):
        plan(spark, only=["no-such-corpus"])


def corpus(seed, n=600):
    rng = random.Random(seed)
    return [(rng.choice(["b-first", "a-second", "c-unclear", "d-closed", "unlisted", None]), i, rng.choice([None, "", "  ", " same ", "same", "x" * 50, f"text {i % 90}", f"text {i}"]), rng.choice(["en", "hi", "xx", None]), rng.choice(["chat", None])) for i in range(n)]


def plain(rows, sources, caps, seed=0, fraction=0.05):
    """The loop over sources and their rows, with a set of texts seen."""
    seen, out, stats = set(), [], {}
    for s in sources:
        per = stats[s] = {"n": 0, "train": 0, "val": 0, "duplicates": 0, "dropped": {}, "lang": {}}
        own = sorted(r for r in rows if r[0] == s)
        for _, i, text, lang, kind in own[: caps.get(s, len(own))]:
            text = (text or "").strip()
            why = "blank" if not text else "long" if len(text) > 40 else None
            if why:
                per["dropped"][why] = per["dropped"].get(why, 0) + 1
            elif text in seen:
                per["duplicates"] += 1
            else:
                seen.add(text)
                side = "val" if int(hashlib.sha256(f"{seed}:{text}".encode()).hexdigest()[:12], 16) % 1000 < fraction * 1000 else "train"
                lang_name = lang if lang in ("en", "hi") else "other"
                per["n"], per[side], per["lang"][lang_name] = per["n"] + 1, per[side] + 1, per["lang"].get(lang_name, 0) + 1
                out.append((side, s, i, text, lang, kind))
    return out, stats


@pytest.mark.parametrize("caps", [{}, {"b-first": 20, "c-unclear": 0}])
def test_files_and_receipt_equal_the_plain_loop(spark, tmp_path, caps):
    rows, out = corpus(3), f"{tmp_path}/prepared"
    table = spark.createDataFrame(rows, "source string, id int, text string, lang string, kind string").repartition(6)
    stats = prep.prepare(table, plan(spark), out, ["id"], caps, [("long", F.length("text") > 40)], ["en", "hi"], fraction=0.3, check=True)
    want, per = plain(rows, ["b-first", "a-second", "c-unclear"], caps, fraction=0.3)
    got = [(r["split"], r["source"], r["id"], r["text"], r["lang"], r["kind"]) for r in spark.read.schema("source string, id int, text string, lang string, kind string, split string").json(out).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for name, own in per.items():
        assert {k: stats["sources"][name][k] for k in own} == own
    assert stats["sources"]["c-unclear"]["publishable"] is False and stats["publishable"] == "unclear" and stats["checked"]
    assert stats["totals"]["n"] == len(want) and stats["refused"] == ["d-closed"]
    assert json.loads((tmp_path / "prepared/stats.json").read_text()) == stats


def test_one_job_and_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "source string, id int, text string, lang string")
    stats = prep.prepare(empty, plan(spark), f"{tmp_path}/p", ["id"], langs=["en"])
    assert stats["totals"] == {"read": 0, "n": 0, "train": 0, "val": 0, "duplicates": 0}
