import random
import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm import quality, queries

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def texts():
    rng = random.Random(7)
    out = [None, "", " \n\t", "a b é😀##\n\nx x\nx x\n \n", "r " * 300, "one two three four five six seven eight " * 3, "x\x1cy\x85z"]
    return out + [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(200))).replace("a b", "a\nb") for _ in range(80)]


@pytest.mark.parametrize("text", texts())
def test_counts_equal_brute_force(text):
    assert quality.statistics(text)[0] == brute(text)


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.6) | (x[:, 4] > 0.7)
    return x, np.where(rng.random(n) < 0.02, bad, ~bad).astype(float)


def test_held_out_accuracy():
    model = quality.train(*sample(3000, 1))
    x, y = sample(2000, 2)
    assert ((model.probability(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_constrained_features_never_raise_the_score():
    x, y = sample(1500, 3)
    flipped = np.where(np.random.default_rng(1).random(1500) < 0.3, 1 - y, y)
    model, grid = quality.train(x, flipped), np.linspace(-1, 2, 60)
    for name in quality.MONOTONE:
        f = quality.FEATURES.index(name)
        for row in x[:40]:
            at = np.repeat(row[None, :], len(grid), axis=0)
            at[:, f] = grid
            assert (np.diff(model.margin(at)) <= 1e-9).all()


def test_one_class_or_no_labels_keep():
    model = quality.train(np.zeros((5, len(quality.FEATURES))), np.ones(5))
    assert model.probability(np.zeros((2, len(quality.FEATURES)))).min() > 0.99
    assert quality.train(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).margin(np.zeros((1, len(quality.FEATURES)))).shape == (1,)


def test_query_and_filter(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice(["tree", "river", "stone", "walk", "green", "north", "song"]) + rng.choice("abcdef") for _ in range(60)) + "."
    junk = lambda: " ".join(rng.choice(["tree", "river", "stone"]) + "$$$ ###" for _ in range(60))
    rows = [(i, junk() if i % 4 == 0 else prose(), i, "z") for i in range(240)] + [(1000, None, 0, "z"), (1001, "short", 0, "z"), (1002, "again and again we go now " * 40, 0, "z"), (None, prose(), 0, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(160)] + [(7, None, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op10_boosted_quality(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        counts = brute(t)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert [got[i][c] for c in NAMES] == counts and got[i]["base_failed"] == failed
        assert got[i]["kept"] == (not failed and not (i is not None and i < 240 and i % 4 == 0))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = quality.keep(docs, model)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.keep(docs.limit(0), model).count() == 0
    none = spark.read.parquet(f"{tmp_path}/labels.parquet").limit(0)
    assert quality.assess(docs, quality.fit(docs, none)).filter("kept and base_failed").count() == 0
