import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from weftline.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.BITS:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c", "A b\x0bC d e", "é x y z w " * 30, "tie tie tie tie tie"])
def test_fingerprint_is_the_defined_one(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_chunks_of_a_long_text_add_up(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    want = brute_fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == want


def near_fingerprints(n, seed):
    rng = random.Random(seed)
    centers = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        f = rng.choice(centers) if rng.random() < 0.9 else rng.getrandbits(64)
        for _ in range(rng.randrange(7)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("bucket", [4096, 40, 6])
def test_all_bucket_sizes_find_every_link(spark, bucket):
    fps = near_fingerprints(300, bucket)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, bucket)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    root = brute_components(fps)
    groups = {}
    for f, r in zip(signed, root):
        groups.setdefault(r, set()).add(f)
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


@pytest.mark.parametrize("bits,bucket", [(3, 40), (4, 6), (7, 4096), (7, 40), (10, 60)])
def test_any_number_of_bits_finds_every_link(spark, monkeypatch, bits, bucket):
    fps = near_fingerprints(200, 100 + bits)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, bucket, bits)).collect()}
    monkeypatch.setattr(simhash, "BITS", bits)
    groups = {}
    for f, r in zip(signed, brute_components(fps)):
        groups.setdefault(r, set()).add(f)
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_words_and_bits_of_the_stage_can_be_given(spark):
    body = [f"word{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(body)), (2, " ".join(body + ["and", "more"]))], "doc_id long, text string")
    a, b = (simhash.fingerprint(" ".join(t), 5) for t in (body, body + ["and", "more"]))
    apart = (a ^ b).bit_count()
    assert apart > 2
    assert simhash.keep_one(docs, 5, apart).count() == 1 and simhash.keep_one(docs, 5, apart - 1).count() == 2


def test_documents_with_nulls_ties_and_clashing_columns(spark):
    body = " ".join(f"word{i}" for i in range(200))
    rows = [(5, body, "x", 1), (3, body.upper(), "x", 1), (9, body + " more", "x", 1), (1, None, "x", 1), (2, "", "x", 1), (2, "", "x", 1), (None, body, "x", 1), (7, "something else altogether here now", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, least int")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    want = [brute_fingerprint(t) for _, t, _, _ in rows]
    root = brute_components(want)
    least = {r: min(rows[j][0] for j in range(len(rows)) if root[j] == r and rows[j][0] is not None) for r in root}
    assert got == sorted((rows[i][0] or -1, least[root[i]]) for i in range(len(rows)))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 7]


def test_null_and_repeated_ids_keep_a_row_of_each_group(spark):
    prose = lambda seed: " ".join(str(random.Random(seed).random()) for _ in range(60)) + " " + " ".join(f"{seed}x{i}" for i in range(60))
    a, b, c, d, e, f = map(prose, range(6))
    rows = [(None, a), (None, a), (None, b), (None, c), (1, c.upper()), (2, c), (2, d), (2, d), (3, e), (3, f), (4, f), (None, f)]
    assert len(set(brute_components([brute_fingerprint(t) for _, t in rows]))) == 6
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, row_key int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
    assert got == sorted([(0, a), (0, b), (1, c.upper()), (2, d), (3, e), (3, f)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def shingle_set(text, words=5):
    split = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(split[i : i + words]) for i in range(max(1, len(split) - words + 1))} if split else set()


def brute_similar(texts, least=0.8):
    """The least position of each text's group: all pairs of similar sets of shingles."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (len(a & b) >= least * len(a | b)) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def test_similar_texts_are_found_and_others_left_alone(spark):
    """Pairs at similarities from 0.5 to 0.97: recall from 0.8 on, none below 0.7."""
    rng, rows, pairs = random.Random(11), [], []
    for i in range(400):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 120, 300, 900]))]
        other = changed(rng, base, max(1, int(len(base) * rng.choice([0.004, 0.01, 0.02, 0.03, 0.05, 0.09]))))
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(other))
        pairs.append((2 * i, len(a & b) / len(a | b)))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, "  ".join(other))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, row_key string").repartition(5)
    out = simhash.keep_one_similar(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert all(i in kept for i, _ in pairs)
    near = [i + 1 not in kept for i, s in pairs if s >= 0.8]
    assert len(near) > 150 and sum(near) >= 0.95 * len(near)
    assert all(i + 1 in kept for i, s in pairs if s < 0.7)


def test_large_groups_and_odd_rows(spark):
    """A group of near copies larger than a bucket, copies in other case and spacing, nulls, repeated rows and ids."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(changed(rng, base, 2))) for i in range(300)] + [(1000, "A b C"), (1001, "a  B c"), (1002, "a b d"), (1003, None), (1004, " "), (None, "a b c"), (None, "lone text of some words here"), (7, "another text under an old name"), (7, "another text under an old name")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = sorted({(rows[j][0], rows[j][1]) for j in set(brute_similar([t for _, t in rows]))} - {(1, "")}, key=str)
    got = sorted((tuple(r) for r in simhash.keep_one_similar(docs, bucket=32).collect()), key=str)
    assert got == want
    assert simhash.keep_one_similar(docs.limit(0)).count() == 0


def test_members_that_their_leader_does_not_verify_meet_each_other(spark, monkeypatch):
    """A chain of texts, each similar to the next one only, in one bucket: no leader is similar to more than two of them."""
    monkeypatch.setattr(simhash, "bands_of", lambda hashes: np.zeros(1, np.uint64))
    rng, texts, words = random.Random(13), [], [f"w{i}" for i in range(120)]
    for i in range(30):
        words = words[2:] + [f"x{i}a", f"x{i}b"] if i % 10 else [f"{i}w{j}" for j in range(120)]
        texts.append(" ".join(words))
        words = words[5:] + [f"y{i}{j}" for j in range(5)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(set(brute_similar(texts)))
    assert len(want) == 3
    for bucket in (4096, 8):
        assert sorted(r["doc_id"] for r in simhash.keep_one_similar(docs, bits=31, bucket=bucket).collect()) == want


def test_pairs_of_a_block_that_are_not_similar_are_not_compared_one_by_one(spark, monkeypatch):
    """Sets that share two thirds with each other: within the bits, but not similar, save one pair. Bounds leave only that one to be compared."""
    import pyarrow as pa

    rng, compared, similar = np.random.default_rng(3), [], simhash.similar
    base = rng.integers(0, 1 << 32, 200, dtype=np.uint64)
    for size in (40, 400):  # whole sets, and least hashes of larger ones
        common = np.concatenate([base, rng.integers(0, 1 << 32, 3 * size, dtype=np.uint64)])
        sets = [np.unique(np.concatenate([rng.choice(common, len(common) * 9 // 10, replace=False), rng.integers(0, 1 << 32, size, dtype=np.uint64)]).astype(np.uint32)) for _ in range(150)]
        sets = [s[: simhash.SKETCH] for s in sets[:-1]] + [sets[0][: simhash.SKETCH]]
        want = {(i, j) for i in range(150) for j in range(i + 1, 150) if similar(sets[i], sets[j])}
        may = simhash.perhaps(sets, sets)
        assert all(may[i, j] for i, j in want) and (simhash.perhaps(sets[:70], sets[70:]) == may[:70, 70:]).all()
        rows = {"k": [1] * 150, "block": [0] * 150, "mine": [0] * 150, "node": range(150), "fp": [0] * 150, "root": range(150), "sketch": [s.tobytes() for s in sets]}
        kinds = dict.fromkeys(rows, pa.int64()) | {"sketch": pa.binary()}
        batch = pa.RecordBatch.from_arrays([pa.array(list(v), kinds[c]) for c, v in rows.items()], names=list(rows))
        monkeypatch.setattr(simhash, "similar", lambda *x: compared.append(x) or similar(*x))
        got = pa.Table.from_batches(list(simhash._pairs_left(iter([batch]), 18, 0.8))).to_pydict()
        assert set(zip(got["a"], got["b"])) <= want and (0, 149) in want
        assert len(compared) < 150 * 149 // 2 // 10
        compared.clear()
