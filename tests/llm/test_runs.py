import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import queries, runs


def brute(word, least=24, times=3):
    """All runs by comparing the sequence with itself at every distance; of equal intervals the smallest period."""
    out = {}
    for q in range(1, len(word)):
        i = 0
        while i + q < len(word):
            j = i
            while j + q < len(word) and word[j] == word[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, p) for (s, e), p in out.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60), st.integers(2, 3), st.integers(4, 9))
def test_runs_of_two_letters(word, times, least):
    assert runs.runs(word, least, times) == brute(word, least, times)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_pieces(pieces):
    word = [c for piece, n in pieces for c in piece * n]
    assert runs.runs(word, 6, 2) == brute(word, 6, 2)
    assert runs.runs(word) == brute(word)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_long_sequences():
    rng = random.Random(5)
    thue = [bin(i).count("1") & 1 for i in range(600)]
    for word in (fibonacci(900), thue, [0] * 500, [rng.randrange(2) for _ in range(800)], ([0] * 9 + [1]) * 60 + fibonacci(300) * 3):
        assert runs.runs(word, 4, 2) == brute(word, 4, 2)
        assert runs.runs(word) == brute(word)


def test_factors_are_the_longest_that_start_earlier():
    rng = random.Random(6)
    for _ in range(60):
        word = [rng.randrange(rng.randrange(1, 4)) for _ in range(rng.randrange(1, 50))]
        at = 0
        for start, size, earlier in runs.factors(word):
            assert start == at
            longest = max((next((k for k in range(len(word) - start + 1) if start + k == len(word) or word[j + k] != word[start + k]), 0) for j in range(start)), default=0)
            assert size == max(1, longest) and (earlier < 0) == (longest == 0)
            assert earlier < 0 or word[earlier : earlier + size] == word[start : start + size]
            at += size
        assert at == len(word)


def want(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("null" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = sorted(brute(words), key=lambda r: (r[0], r[2]))
    drop = {i for s, e, p in found for i in range(s + p, e)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, digest("".join(f"{s},{e - s},{p}\n" for s, e, p in found)), digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


def corpus(seed, n=160):
    rng, out = random.Random(seed), []
    vocabulary = ["a", "b", "é", " x", "日本", "zz​", *(f"w{i}" for i in range(200))]
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 30, 80, 200]))]
        for _ in range(rng.randrange(3)):
            piece, at = [rng.choice(vocabulary[: rng.choice([2, 9])]) for _ in range(rng.randrange(1, 14))], rng.randrange(len(words) + 1)
            words[at:at] = (piece * rng.randrange(2, 30))[: rng.randrange(10, 200)]
        text = "".join(w + rng.choice([" ", "\n", "\t", "  ", "\r\n", "\x0b"]) for w in words)
        out.append((rng.choice([i, i, i * 10**12, 3, None]), text if rng.random() < 0.9 else text.strip() or None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    rows = corpus(seed) + [(5, "no no " * 3000), (6, " ".join(map(str, range(3000))) + " x y" * 50), (None, ""), (None, None), (7, "x" * 100_000)]
    spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, start long, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = sorted((want(*r) for r in rows), key=str)
    assert any(r[1] > 1 for r in expected)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected


def test_empty_table_and_rows_that_touch(spark):
    assert runs.periodic(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    # Neighbouring rows without white space between them are no common words, and no common run.
    docs = spark.createDataFrame([(i, " ".join(["ab"] * 12)) for i in range(6)], "doc_id long, text string").coalesce(1)
    assert [len(r["runs"]) for r in runs.periodic(docs).collect()] == [0] * 6
