import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import arrow_words, queries, resample


def features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(docs, benchmark):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [d[1] for d in docs]), (t, benchmark)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)]
    out, able = [], []
    for at, (i, text) in enumerate(docs):
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if n >= 20:
            able.append((-score, i is None, i or 0, at))
    for rank, (*_, at) in enumerate(sorted(able)[: 25 * len(able) // 100]):
        out[at][4] = rank + 1
    return sorted(map(tuple, out), key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "café", "ÀB", "x1", "don't", "co-op", "日本語", "a", "Z9", "naïve", "k" * 70, "q" * 49, "q" * 48, *(f"Word{i}" for i in range(40))]
    make = lambda: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_", "\x7f", "--"]) for _ in range(rng.choice([0, 3, 19, 20, 21, 60])))
    return [(rng.choice([i, i, i, 5, None]), rng.choice([make(), make(), make(), None, ""])) for i in range(n)], [make() for _ in range(20)] + [None]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    docs, benchmark = corpus(seed)
    docs += [(10**15, "long " * 60_000), (-4, "y" * 300_000)] + [(9, "equal rows all over " * 8)] * 40
    spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, score string, bucket int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(benchmark)], "item_id int, text string, n int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op13_importance_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows, expected = [tuple(r) for r in got.collect()], brute(docs, benchmark)
    # Rows of one doc_id and one score take their ranks in any order.
    for part in (lambda r: r[:4], lambda r: (r[0], *r[3:])):
        assert sorted(map(part, rows), key=str) == sorted(map(part, expected), key=str)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(empty, empty).count() == 0 and resample.resample(empty, one).count() == 0
    assert [r["rank"] for r in resample.resample(one, empty, 100, 1).collect()] == [1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(codec="utf-8"), max_size=40)), max_size=12), st.integers(1, 60))
def test_words_and_checksums_of_any_slices(texts, at_once):
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    got = [[] for _ in texts]
    for words in arrow_words.sliced(column, resample.WORD_BYTES, at_once):
        for bucket, row in zip(*(x.tolist() for x in resample.features(words))):
            got[words.first + row].append(bucket)
    assert list(map(sorted, got)) == [sorted(features(t)[1]) for t in texts]


def test_the_draw_leans_towards_the_target(spark):
    rng = random.Random(3)
    make = lambda kind: " ".join(f"{kind}{rng.randrange(50)}" for _ in range(40))
    docs = spark.createDataFrame([(i, make("sport" if i % 4 == 0 else "law")) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(make("sport"),) for _ in range(60)], "text string")
    drawn = [r["doc_id"] for r in resample.resample(docs, target).filter("rank is not null").collect()]
    assert len(drawn) == 100 and np.mean([i % 4 == 0 for i in drawn]) > 0.7
