import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.llm import queries, substr


def brute(docs):
    """docs: {doc_id: text}; {doc_id: kept words} by the definition."""
    words = {k: [w for w in (t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w] for k, t in docs.items()}
    seen, copies = set(), {}
    for k in sorted(words):
        w, drop = words[k], set()
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                drop.update(range(s, s + 20))
            seen.add(window)
        copies[k] = [x for i, x in enumerate(w) if i not in drop]
    return words, copies


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "the", "of"]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [prose(k) for k in (19, 20, 21, 40, 55, 120)]
    out = {}
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += prose(rng.randrange(0, 60))
            if rng.random() < 0.6:
                p = list(rng.choice(passages))
                if rng.random() < 0.3:
                    p[rng.randrange(len(p))] = "changed"
                parts += p
        out[i * 3 - 20] = "  ".join(parts) if i % 2 else "\n\t".join(parts)
    out[1000], out[1001] = None, ""
    out[1002] = "x " * 500
    out[1003] = "x " * 30 + "y"
    out[1004] = out[1]
    return out


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "z") for k, t in docs.items()], "doc_id long, text string, places string")


def test_query_equals_brute_force(spark, tmp_path):
    docs = corpus(1)
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    words, kept = brute(docs)
    got = {r["doc_id"]: r for r in queries.op5_fingerprint_index(spark, str(tmp_path)).collect()}
    assert set(got) == set(docs)
    for k in docs:
        assert (got[k]["n_words"], got[k]["n_removed"]) == (len(words[k]), len(words[k]) - len(kept[k])), k
        assert got[k]["kept_sha256"] == hashlib.sha256(" ".join(kept[k]).encode()).hexdigest()


def by_batches(spark, docs, batches, max_runs=2):
    index, marks, levels = substr.FingerprintIndex(spark, max_runs), [], []
    for part in batches:
        marks.append(index.append(part))
        levels.append((len(index.grams.runs), len(index.windows.runs)))
    index.drop()
    assert not index.grams.runs and not index.windows.runs
    return substr.kept(docs, marks), index, levels


def test_runs_and_compaction_give_the_same(spark):
    docs = corpus(2, 40)
    table = frame(spark, docs)
    _, kept = brute(docs)
    edges = [-100, 0, 20, 40, 60, 80, 2000]
    out, _, levels = by_batches(spark, table, [table.filter((F.col("doc_id") > a) & (F.col("doc_id") <= b)) for a, b in zip(edges, edges[1:])])
    assert levels == [(1, 1), (2, 2), (1, 1), (2, 2), (1, 1), (2, 2)]
    assert {r["doc_id"]: r["kept"] for r in out.collect()} == {k: " ".join(w) for k, w in kept.items()}


def test_runs_are_merge_joined_without_a_shuffle(spark):
    index = substr.FingerprintIndex(spark)
    index.append(frame(spark, {1: "x y z " * 20}))
    index.append(frame(spark, {2: "x y z " * 30}))
    one, two = index.grams.runs
    plan = spark.table(one).join(index.grams.others(one)[0], "h", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and two
    index.drop()


def test_only_history_that_a_candidate_points_to_is_read_again(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    plain = lambda k: " ".join(f"d{k}w{i}" for i in range(100))
    docs = {k: plain(k) for k in range(50)} | {7: "early " + passage}
    new = {100: "before " + passage + " after", 101: plain(101)}
    newest = {200: passage + " again", 201: plain(201)}
    parts = [frame(spark, d) for d in (docs, new, newest)]
    out, index, _ = by_batches(spark, parts[0].union(parts[1]).union(parts[2]), parts, 4)
    # The passage is opened once, with the second batch; the third finds its windows in the runs.
    assert index.read_again[:2] == [0, 1] and index.read_again[2] <= 1
    got = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert got[7] == docs[7] and got[100] == "before after" and got[200] == "again" and got[201] == newest[201]


def brute_rows(rows):
    """The words that each of the rows (doc_id, text) keeps; places in the order of doc_id (null last), start, text hash."""
    split = [(t or "").split() for _, t in rows]
    first = {}
    order = [(k is None, k or 0) for k, _ in rows]
    for i, w in enumerate(split):
        for s in range(len(w) - 19):
            window, place = tuple(w[s : s + 20]), (*order[i], s)
            first.setdefault(window, set()).add((place, rows[i][1]))
    out = []
    for i, w in enumerate(split):
        sure, maybe = set(), set()
        for s in range(len(w) - 19):
            places = first[tuple(w[s : s + 20])]
            least = min(p for p, _ in places)
            ties = {t for p, t in places if p == least}
            if least < (*order[i], s):
                sure.update(range(s, s + 20))
            elif len(ties) > 1:
                maybe.update(range(s, s + 20))
        out.append((" ".join(x for p, x in enumerate(w) if p not in sure), " ".join(x for p, x in enumerate(w) if p not in sure | maybe)))
    return out


def test_null_repeated_and_extreme_doc_ids_equal_brute_force(spark):
    rng, texts = random.Random(4), list(corpus(5, 70).values())
    ids = [None, None, None, 3, 3, 17, (1 << 63) - 1, -(1 << 63), (1 << 53) + 1, (1 << 53) + 2]
    rows = [(rng.choice(ids), t) for t in texts]
    rows += rng.sample(rows, 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for row, kept in zip(rows, brute_rows(rows)):
        want.setdefault(row, kept)
    for batches in (1, 6):
        got = substr.deduplicate_in_batches(docs, batches).collect()
        assert sorted((str(r["doc_id"]), r["n_words"]) for r in got) == sorted((str(k), len((t or "").split())) for k, t in rows)
        left = [(str(r["doc_id"]), r["kept"]) for r in got]
        for (k, _), (most, least) in zip(rows, (want[row] for row in rows)):
            hit = next(x for x in left if x[0] == str(k) and x[1] in (most, least))
            left.remove(hit)


def test_a_copy_under_null_or_repeated_ids_goes_whole(spark):
    passage, other = " ".join(f"p{i}" for i in range(30)), " ".join(f"o{i}" for i in range(40))
    for second in (None, 2):
        docs = spark.createDataFrame([(1, passage), (second, "q " + passage), (second, other)], "doc_id long, text string")
        got = sorted((r["n_words"], r["n_removed"]) for r in substr.deduplicate_in_batches(docs).collect())
        assert got == [(30, 0), (31, 30), (40, 0)]


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(4, text), (4, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substr.deduplicate_in_batches(docs).collect())
    assert got == [(-1, 0, 0), (-1, 30, 30), (4, 30, 0), (4, 30, 0)]
    assert substr.deduplicate_in_batches(docs.limit(0)).count() == 0


def test_codes_tell_words_apart():
    rng = random.Random(7)
    words = [bytes(rng.choice(b"ab\x00\xc3\xa9") for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 300]))) for _ in range(3000)]
    text = b" \t" + b"".join(w + rng.choice([b" ", b"\n\n", b"\x0b\x0c\r"]) for w in words)
    held = np.frombuffer(text, np.uint8)
    starts, ends = substr._edges(held)
    assert [text[i:j] for i, j in zip(starts, ends)] == words == text.split()
    for seed in (0, 1):
        pairs = set(zip(words, substr._codes(held, starts, ends, seed).tolist()))
        assert len(pairs) == len(set(words)) == len({code for _, code in pairs})
    many = np.frombuffer(b"ab c " * (substr.WORDS_AT_ONCE + 3), np.uint8)
    assert len(set(substr._codes(many, *substr._edges(many), 0).tolist())) == 2


def test_the_query_goes_through_compaction_before_its_last_batch(spark, tmp_path, monkeypatch):
    docs, steps, append, compact = corpus(6), [], substr.FingerprintIndex.append, substr.Level.compact

    def compacting(level):
        before = set(level.runs)
        compact(level)
        steps.append("compacted" if not before & set(level.runs) else "added")

    monkeypatch.setattr(substr.Level, "compact", compacting)
    monkeypatch.setattr(substr.FingerprintIndex, "append", lambda index, batch: steps.append("batch") or append(index, batch))
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    words, kept = brute(docs)
    got = {r["doc_id"]: r["kept_sha256"] for r in queries.op5_fingerprint_index(spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256(" ".join(kept[k]).encode()).hexdigest() for k in docs}
    last = len(steps) - 1 - steps[::-1].index("batch")
    assert steps[:last].count("compacted") == 2 and steps.count("batch") > 2


def test_gram_runs_are_aggregated_by_hash(spark, monkeypatch):
    plans, write = [], substr.Level.write

    def noted(level, run):
        if level.keys == ["h"]:
            plans.append(run._jdf.queryExecution().executedPlan().toString())
        return write(level, run)

    monkeypatch.setattr(substr.Level, "write", noted)
    index = substr.FingerprintIndex(spark, 1)
    for k in range(2):
        index.append(frame(spark, {k: "x y z " * 20 + f"d{k}"}))
    index.drop()
    assert len(plans) == 3 and all("HashAggregate" in p and "SortAggregate" not in p for p in plans)


def test_marks_of_many_texts_equal_those_of_each(monkeypatch):
    texts = [None, "", *corpus(8, 30).values(), "end", "", "begin " * 25, "x" * 70 + " y" * 30, " z" * 19, "é\x0bw " * 20, "last"]
    made = []
    for at_once in (1, 500, 1 << 20):
        monkeypatch.setattr(substr, "AT_ONCE", at_once)
        out = []
        for first, marks in substr._marks(pa.array(["before", *texts], pa.string()).slice(1)):
            assert marks.rows == 1 or len(marks.data) <= at_once
            count = marks.count.tolist()
            assert count == [len((t or "").split()) for t in texts[first : first + marks.rows]]
            if marks.long:
                unique = pa.array([[0, 3, 900] if i % 2 else None for i in range(first, first + marks.rows)], pa.list_(pa.int32()))
                starts = marks.candidates(unique)
                hashes = zip(*(x.tolist() for x in marks.windows(starts)))
                out += [(first + r, s - marks.base[r], *ab) for s, r, ab in zip(starts.tolist(), marks.row[starts].tolist(), hashes)]
                stays = marks.staying(unique, unique)
                out += [(first + r, "stays", stays[marks.base[r] : marks.base[r + 1]].tolist()) for r in range(marks.rows) if count[r] >= substr.WIDTH]
        made.append(sorted(out, key=str))
    assert made[0] == made[1] == made[2] and len(made[0]) > 100
