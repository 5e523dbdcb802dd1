import random
import zlib
from collections import Counter, defaultdict

import pytest

from weftline.llm import queries, sharding


def test_tree_takes_the_tightest_fit():
    rng = random.Random(1)
    tree, plain = sharding.Tree(), []
    for step in range(3000):
        if rng.random() < 0.5 or not plain:
            key = (rng.randrange(500), step)
            tree.insert(key), plain.append(key)
        else:
            bound = rng.randrange(550)
            want = min((k for k in plain if k[0] >= bound), default=None)
            assert tree.take_from(bound) == want
            if want:
                plain.remove(want)


def test_pack_is_best_fit():
    rng = random.Random(2)
    sizes = sorted((rng.randrange(1, 100) for _ in range(200)), reverse=True)
    got, room = sharding.pack(sizes, 150, 200), []
    for size, bin_ in zip(sizes, got):
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        if fits:
            assert bin_ == min(fits)[1]
            room[bin_] -= size
        else:
            assert bin_ == len(room)
            room.append(150 - size)
    assert sharding.pack([10], 5, 3) is None and sharding.pack([3, 3], 5, 1) is None


def test_items_larger_than_an_even_share_stand_alone():
    where = sharding.best_fit_decreasing([("huge", 1000), *[(f"i{i}", 10) for i in range(90)]], 10)
    alone = where["huge"]
    assert [n for n, b in where.items() if b == alone] == ["huge"]
    assert set(Counter(b for n, b in where.items() if n != "huge").values()) == {10}


def rows_of(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, shard string").write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op7_binpack_shards(spark, str(tmp_path)).collect()


def test_query_keeps_groups_and_the_law(spark, tmp_path):
    rng = random.Random(3)
    texts = [("é" if rng.random() < 0.2 else "x") * rng.randrange(1, 400) + str(rng.randrange(900)) for _ in range(2000)]
    docs = [(i, rng.choice(texts[:40]) if i % 5 == 0 else t, "z") for i, t in enumerate(texts)] + [(5000 + i, "hot text " * 20, "z") for i in range(1000)] + [(9000, None, "z"), (9001, "", "z"), (None, "n", "z"), (3, docs_text := "again", "z"), (3, docs_text, "z")]
    got = rows_of(spark, tmp_path, docs)
    text_of = defaultdict(set)
    for i, t, _ in docs:
        text_of[i].add(t)
    assert len(got) == len(docs)
    sizes, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        if len(text_of[r["doc_id"]]) == 1:
            (t,) = text_of[r["doc_id"]]
            assert r["size"] == len((t or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((t or "").encode())
            homes[t].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
    even = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) < 0.1 * even
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    group = Counter()
    for i, t, _ in docs:
        group[t] += len((t or "").encode()) + 16
    assert all(len(h) == 1 for t, h in homes.items() if group[t] <= even)
    assert len(homes["hot text " * 20]) > 1


@pytest.mark.parametrize("rows", [[], [(1, "only", "z")], [(i, "same", "z") for i in range(7)], [(None, None, "z")] * 3])
def test_small_tables(spark, tmp_path, rows):
    got = rows_of(spark, tmp_path, rows)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_law_holds_where_doc_ids_are_null_repeated_or_extreme(spark):
    same = "copy " * 80
    rows = [(None, same, "s")] * 400 + [(7, same, "s")] * 200 + [((1 << 63) - 1, f"t{i}" * 50, "s") for i in range(40)] + [(-(1 << 63), None, "s")] * 5
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, shard string"), 4).collect()
    assert len(got) == len(rows)
    sizes, slots = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0))
    assert set(sizes) == {0, 1, 2, 3}
    assert max(sizes.values()) <= 1.05 * sum(sizes.values()) / 4
    assert all(sorted(s for s, _, _ in x) == list(range(len(x))) for x in slots.values())
