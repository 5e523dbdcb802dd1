"""Manifests, utterances, speech indices, tables and logs."""

import io
import json
import tarfile
import wave

import pytest
from pyspark.sql import functions as F

from weftline.operators import corpus, splits
from weftline.sources import manifest, speech, tables, utterances


def wav(seconds, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(b"\x00\x40" * int(seconds * rate))
    return out.getvalue()


ENTRY = 'name = "{}"\ntarget = "persona_lora"\npriority = {}\nhf_id = "{}"\nlicense = "L"\nflags = [{}]\naccess = "direct"\nsize_gb = 1.5\nweights_publishable = "{}"\n'


def toml(*entries, version=1):
    return f"schema_version = {version}\n" + "".join("[[dataset]]\n" + ENTRY.format(*e) for e in entries)


def test_manifest_statuses_and_selection(spark):
    text = toml(("phinc", 2, "a/p", '"permissive"', "yes"), ("goemotions", 1, "a/g", '"NC"', "no"), ("cmu-hinglish-dog", 1, "a/c", '"SA"', "unclear"), ("soda", 1, "a/s", '"permissive"', "yes"), ("other", 1, "a/o", '"permissive"', "yes"))
    table = manifest.parse(spark, text)
    readable, complete = ["phinc", "goemotions", "cmu-hinglish-dog", "soda"], F.col("name") != "soda"
    status = lambda **k: {r["name"]: r["status"] for r in corpus.licence_status(table, readable, complete, **k).collect()}
    assert status() == {"phinc": "included", "goemotions": "refused", "cmu-hinglish-dog": "included", "soda": "missing", "other": "unreadable"}
    assert status(publishable_only=True)["cmu-hinglish-dog"] == "refused"
    assert [r["name"] for r in manifest.select(table).collect()] == ["goemotions", "cmu-hinglish-dog", "soda", "other"]
    assert [r["name"] for r in manifest.select(table, only=["phinc", "soda"]).collect()] == ["soda", "phinc"]
    totals = {r["target"]: (r["n"], r["size_gb"]) for r in manifest.totals(table).collect()}
    assert totals["persona_lora"] == (5, 7.5) and totals["hindi_stt"] == (0, 0.0)


@pytest.mark.parametrize("text", [
    toml(("A b", 1, "x", "", "no")), toml(("a", 4, "x", "", "no")), toml(("a", 1, "", "", "no")), toml(("a", 1, "x", '"NC"', "yes")), toml(("a", 1, "x", "", "no"), ("a", 1, "y", "", "no")),
    toml(("a", 1, "X/", "", "no"), ("b", 1, "x", "", "no")), toml(("a", 1, "x", "", "no"), version=2), toml(("a", 1, "x", '"odd"', "no")),
])
def test_bad_manifests_are_refused(spark, text):
    with pytest.raises(ValueError):
        manifest.parse(spark, text)


def test_licence_lookup(spark):
    table = manifest.parse(spark, toml(("a", 1, "x", "", "yes"), ("b", 1, "y", '"NC"', "no")))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, source string")
    got = {r["id"]: (r["licence"], r["weights_publishable"]) for r in corpus.licensed(rows, table).collect()}
    assert got == {1: ("L", "yes"), 2: ("L", "no"), 3: ("unknown", "unclear")}
    assert [r["id"] for r in corpus.publishable(rows, table).collect()] == [1]
    worst = lambda ids: corpus.licensed(rows.filter(F.col("id").isin(ids)), table).agg(corpus.verdict().alias("v")).first()["v"]
    assert (worst([1]), worst([1, 3]), worst([1, 2, 3]), worst([9])) == ("yes", "unclear", "no", "yes")


def test_utterances_from_names(spark, tmp_path):
    names = {"crema-d": ["1001_DFA_ANG_XX.wav", "notes.wav"], "ravdess": ["03-01-05-01-02-01-12.wav", "03-01-09-01-02-01-12.wav"], "tess": ["OAF_back_angry.wav", "yaf_dog_pleasant_surprise.wav"], "savee": ["DC_a01.wav", "DC_su02.wav"], "rasa": ["female_HAPPY_3.wav", "female_WIKI_3.wav"]}
    for corpus_name, files in names.items():
        (tmp_path / corpus_name / "in").mkdir(parents=True)
        for f in files:
            (tmp_path / corpus_name / "in" / f).write_bytes(b"x")
    got = sorted((r["speaker"], r["label"], r["raw_label"]) for r in utterances.load(spark, str(tmp_path), list(names)).collect())
    assert got == sorted([("crema-d:1001", "anger", "ANG"), ("ravdess:12", "anger", "anger"), ("tess:OAF", "anger", "angry"), ("tess:yaf", "surprise", "pleasant_surprise"), ("savee:DC", "anger", "anger"), ("savee:DC", "surprise", "surprise"), ("rasa:female", "happy", "HAPPY")])
    all_rows = {(r["corpus"], r["label"], r["kind"]): (r["n"], r["speakers"]) for r in utterances.summary(utterances.load(spark, str(tmp_path), list(names))).collect()}
    assert all_rows[None, None, None] == (7, 6) and all_rows[None, None, "acted"] == (7, 6) and all_rows[None, "surprise", None] == (2, 2)


def test_archives_are_listed_where_there_are_no_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    with tarfile.open(tmp_path / "r/x.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("deep/1001_DFA_SAD_XX.wav")
        tar.addfile(info, io.BytesIO(b""))
        tar.addfile(tarfile.TarInfo("deep/readme.txt"), io.BytesIO(b""))
    (row,) = utterances.READERS["crema-d"](spark, f"{tmp_path}/r").collect()
    assert row["label"] == "sad" and row["path"].endswith("x.tar.gz::deep/1001_DFA_SAD_XX.wav")


def test_rated_bench(spark, tmp_path):
    base = tmp_path / "extracted"
    base.mkdir()
    for f in ("a.wav", "b.wav", "c.wav"):
        (base / f).write_bytes(b"x")
    (base / "index.csv").write_text("file,clip,category,intensities\na.wav,s1,Shame,1;2;2\nb.wav,s2,Shame,1;0\nc.wav,s3,Arousal,1\ngone.wav,s4,Shame,2\nb.wav,s5,Shame,x\n")
    assert [(r["speaker"], r["label"]) for r in utterances.agreed_bench(spark, str(tmp_path)).collect()] == [("emonet-voice-bench:s1", "ashamed")]


def test_speech_index_reasons_and_late_audio(spark, tmp_path):
    rows = [("1", 1.0, "ok", (wav(1.0), "p")), (None, 1.0, "x", None), ("1", None, "x", None), ("1", 1.0, " ", None), ("1", 1.0, "so <noise>", None), ("1", 31.0, "x", None), ("1", 0.2, "x", None)]
    shape = "speaker_id string, duration double, text string, audio struct<bytes:binary,path:string>"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/w")
    (part,) = (tmp_path / "w").glob("*.parquet")
    (tmp_path / "c").mkdir()
    part.rename(tmp_path / "c/train-0.parquet")
    spec = speech.Corpus("k", "text", "speaker_id", "duration")
    found = speech.index(spark, spec, f"{tmp_path}/c")
    assert [r["skip_reason"] for r in found.orderBy("row_index").collect()] == [None, "missing_column", "no_duration", "empty_text", "annotator_tag", "too_long", "too_short"]
    good = found.filter("skip_reason is null")
    assert good.first()["speaker"] == "k:1" and good.first()["declared_split"] == "train"
    (clip,) = speech.clips(spark, f"{tmp_path}/c", good).collect()
    assert len(clip["samples"]) == 8000 and abs(clip["samples"][0] - 0.5) < 1e-6
    timed = speech.index(spark, speech.Corpus("k", "text", "speaker_id", None), f"{tmp_path}/c")
    assert [r["seconds"] for r in timed.filter("row_index = 0").collect()] == [1.0]
    lacking = speech.index(spark, speech.Corpus("k", "text", "who", "duration"), f"{tmp_path}/c")
    assert {r["skip_reason"] for r in lacking.collect()} == {"missing_column"}


def test_split_leaves_no_speaker_on_both_sides(spark):
    rows = [(f"k:{s}", "train", i, 3600.0) for i, s in enumerate([0, 0, 1, 1, 2, 2])] + [(f"k:{s}", "valid", 10 + i, 3600.0) for i, s in enumerate([0, 0, 1, 1])]
    table = spark.createDataFrame(rows, "speaker string, declared_split string, row_index long, seconds double").withColumn("corpus", F.lit("k"))
    held = speech.held_out([speech.Corpus("k", "t", "s", held_out=("valid",))])
    plan = splits.plan_split(table, held, ["row_index"], eval_limit=1)
    assert {r["split"]: r["count"] for r in plan.groupBy("split").count().collect()} == {"eval": 1, "left": 3, "leak": 4, "train": 2}
    assert splits.leaks(plan).count() == 0
    capped = splits.plan_split(table, held, ["row_index"], hours=1.0)
    assert {r["split"]: r["count"] for r in capped.groupBy("split").count().collect()} == {"eval": 4, "leak": 4, "train": 1, "over": 1}


def test_tables_logs_and_snapshots(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "t/b.csv").write_text('x,y\n3,"a\nb"\n')
    (tmp_path / "t/c.jsonl").write_text('{"x": 4}\n\n')
    (tmp_path / "t/.hidden.jsonl").write_text('{"x": 9}\n')
    assert sorted((r["x"], r["y"]) for r in tables.read_tables(spark, f"{tmp_path}/t", "x int, y string").collect()) == [(1, None), (2, None), (3, "a\nb"), (4, None)]
    (tmp_path / "log.jsonl").write_text('{"turn": 1, "tier": "local"}\n{"turn": 2}\n{"turn": 3, "ti')
    assert [r["turn"] for r in tables.json_log(spark, f"{tmp_path}/log.jsonl", "turn int, tier string").collect()] == [1, 2]
    assert tables.json_log(spark, f"{tmp_path}/none.jsonl", "turn int").count() == 0
    state = spark.createDataFrame([("d", 1.0)], "device string, v double")
    tables.snapshot(state, f"{tmp_path}/s", 1)
    assert tables.read_snapshot(spark, f"{tmp_path}/s", "device string, v double", 1).count() == 1
    assert tables.read_snapshot(spark, f"{tmp_path}/s", "device string, v double", 2).count() == 0
    assert tables.read_snapshot(spark, f"{tmp_path}/none", "device string", 1).count() == 0


def test_shards_drifting_columns_and_receipts(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "text string, n int").coalesce(1).write.parquet(f"{tmp_path}/p/one")
    spark.createDataFrame([("b", "g")], "sentence string, accent string").coalesce(1).write.parquet(f"{tmp_path}/p/two")
    got = tables.drifting(spark, [f"{tmp_path}/p/one", f"{tmp_path}/p/two"], {"text": ("text", "sentence"), "accent": ("accent",)})
    assert sorted((r["text"], r["accent"]) for r in got.collect()) == [("a", None), ("b", "g")]
    assert len(tables.shards(spark, f"{tmp_path}/p")) == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.bin").write_bytes(b"abc")
    files = tables.digests(spark, f"{tmp_path}/f")
    receipts = spark.createDataFrame([("x.bin", files.first()["sha256"]), ("x.bin", "0" * 64), ("x.bin", "etag"), ("y.bin", "etag")], "name string, sha256 string")
    assert sorted((r["sha256"][:4], r["status"]) for r in tables.verified(receipts, files).collect()) == sorted([(files.first()["sha256"][:4], "ok"), ("0000", "mismatch"), ("etag", "ok"), ("etag", "missing")])
    order = [r["id"] for r in tables.shuffled(spark.range(20), 1, ["id"]).collect()]
    assert order != list(range(20)) and order == [r["id"] for r in tables.shuffled(spark.range(20).repartition(5), 1, ["id"]).collect()]
    assert tables.resumed(spark.range(5), ["id"], 3).count() == 2
