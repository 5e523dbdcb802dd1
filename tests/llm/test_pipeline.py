import random
import sys
from pathlib import Path

import corpus_pipeline as pipeline
from weftline.llm import quality

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from test_bpe import THEIRS, ids  # noqa: E402
from test_pii import brute as spans  # noqa: E402
from test_simhash import brute_similar  # noqa: E402


def redacted(text):
    out, at = "", 0
    for span in spans(text):
        kind, start, end = span.split(":")
        if int(start) >= at:
            out += text[at : int(start)] + f"[{kind.upper()}]"
            at = int(end)
    return out + text[at:] if text else text


def corpus():
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("aeioutrnsl") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows, base = [], prose(120)
    for i in range(120):
        kind = i % 6
        if kind < 3:
            base = prose(rng.randrange(40, 200))
        text = "$$$ ### " * 30 + prose(30) if kind == 4 else base + " and mail jo@ex.org or 1.2.3.4" if kind == 5 else base
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
    return rows + [(500, None, "en", None, 0), (501, "tiny", "en", "src1", 4)]


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 6 == 4 else 1, 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    kept = [r for r, ok in zip(rows, quality.verdicts(model, [r[1] for r in rows])[2]) if ok]
    assert {r[0] % 6 for r in kept} == {0, 1, 2, 3, 5}
    root = brute_similar([r[1] for r in kept])
    firsts = [r for i, r in enumerate(kept) if root[i] == i]
    assert len(firsts) < len(kept)
    clean = [(r[0], r[3], redacted(r[1])) for r in firsts]
    copies = brute.mix(clean)
    want = []
    for (i, _, text), n in zip(clean, copies):
        want += [(i, THEIRS.encode_ordinary(text or ""))] * n
    assert sorted((r["doc_id"], ids(r["ids"])) for r in got) == sorted(want)
    assert all(r["round_trip"] and r["n_tokens"] == len(ids(r["ids"])) for r in got)


def test_stages_keep_the_columns_and_survive_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    """Null and repeated ids, equal rows, ties, a very long text, extra columns under names that the stages use themselves."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("aeioutrnsl") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    shared, long = prose(80), prose(60_000)
    texts = [None, "", "tiny", shared, shared, shared + " end", long, *[prose(60) for _ in range(12)]]
    ids = [None, None, 3, 4, 4, 5, 6, 7, 7, None, None, *range(20, 28)]
    rows = [(i, t, "en", None if j % 3 == 0 else f"s{j % 2}", 0, "mine", j, b"k", 0.5) for j, (i, t) in enumerate(zip(ids, texts))]
    rows.append(rows[4])
    shape = "doc_id long, text string, lang string, source string, n_chars long, row_key string, mix_copy int, k binary, score double"
    spark.createDataFrame([(20, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, shape)
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == docs.columns, name
        docs = out
        if name == "quality rules":
            assert sorted(r["text"] for r in docs.collect()) == sorted([t for t in texts if t and len(t) > 10] + [shared])
        if name == "near duplicates":
            kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert len(kept) == 14 and (4, shared) in kept and (6, long) in kept and sum(i is None for i, _ in kept) == 2
    copies = docs.count()
    last = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == copies > 0 and all(r["round_trip"] for r in last)
