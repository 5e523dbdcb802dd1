"""Turns by hand, in batch and on a stream in any micro-batches; hops across the borders of frames."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from weftline.operators import listen
from weftline.streaming import listening

QUIET, LOUD = (0.1, 0.2, 0.0, False), (0.95, 0.2, 0.0, False)
DONE, PLAY = (0.1, 0.2, 0.9, False), (0.1, 0.2, 0.0, True)


def events(frames, machine=None):
    machine = machine or listen.Turns()
    return [(i, *made) for i, made in enumerate(machine.feed(*f) for f in frames) if made[0]]


def test_an_utterance_has_its_pre_roll_and_ends_where_the_end_is_probable():
    # 20 quiet frames; speech from 20 on, known at 22; 10 frames (0.3 s) ahead belong to it; the gate closes after 7 quiet ones.
    got = events([QUIET] * 20 + [LOUD] * 10 + [DONE] * 20)
    assert got == [(36, "utterance", 10, 36, False)]
    # The pause goes on, and so does the utterance; asked again every 7 frames.
    got = events([QUIET] * 20 + [LOUD] * 10 + [QUIET] * 10 + [LOUD] * 10 + [QUIET] * 9 + [DONE] * 20)
    assert got == [(63, "utterance", 10, 63, False)]
    # No end is probable: after two seconds of waiting it is closed.
    got = events([QUIET] * 20 + [LOUD] * 10 + [QUIET] * 100)
    assert got == [(36 + 63, "utterance", 10, 99, True)]
    assert events([LOUD] * 5 + [DONE] * 20) == [(11, "utterance", 0, 11, False)]


def test_interruptions_true_and_false():
    # Playback begins at 5; dead for 7 frames, then 8 in a row.
    loud = [PLAY, *[LOUD] * 30]
    got = events([QUIET] * 5 + loud + [DONE] * 30)
    assert got[0] == (18, "barge_in", 1, 18, False) and got[1][1] == "utterance" and got[1][2] == 1 and len(got) == 2
    # A cough: quiet again soon, so playback goes on and can be interrupted again.
    cough = [PLAY, *[LOUD] * 14, *[QUIET] * 60, *[LOUD] * 30]
    kinds = [(e[1]) for e in events([QUIET] * 5 + cough + [DONE] * 60)]
    assert kinds[:3] == ["barge_in", "resume", "barge_in"]
    # Below the echo floor nothing is heard of it.
    assert events([(0.1, 0.2, 0.0, True)] + [(0.99, 0.001, 0.0, False)] * 60) == []


def sequence(seed, n):
    rng, out = random.Random(seed), []
    while len(out) < n:
        if rng.random() < 0.08:
            out += [*[DONE] * 80, PLAY, *[LOUD] * 15, *[QUIET] * 60]
        out += [rng.choice([QUIET, LOUD, LOUD, DONE, PLAY if rng.random() < 0.3 else LOUD])] * rng.randrange(1, 14)
    return out[:n]


def test_stored_state_goes_on():
    frames = sequence(1, 800)
    for cut in (1, 100, 431):
        first = listen.Turns()
        head = events(frames[:cut], first)
        rest = [(i + cut, *e) for i, *e in events(frames[cut:], listen.Turns(state=listen.State(*first.stored())))]
        assert head + rest == events(frames)


@pytest.fixture(scope="module")
def rows():
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return [(k, start + timedelta(milliseconds=32 * i), bytes([i % 251, s]), *f) for s, k in enumerate(("left", "right")) for i, f in enumerate(sequence(s + 3, 600))]


SHAPE = "key string, at timestamp, samples binary, p double, level double, complete double, begins boolean"


def expected(rows):
    out = []
    for key in ("left", "right"):
        own = [r for r in rows if r[0] == key]
        for i, kind, first, last, forced in events([r[3:] for r in own]):
            out.append((key, i, kind, first, last, forced, b"".join(r[2] for r in own[first : last + 1]) if kind == "utterance" else None))
    return sorted(out)


def test_batch_equals_the_machine(spark, rows):
    want = expected(rows)
    assert {e[2] for e in want} == {"utterance", "barge_in", "resume"}
    table = spark.createDataFrame(rows, SHAPE).repartition(5)
    found = listen.turns(table, ["key"], ["at"])
    assert sorted((r["key"], r["frame"], r["kind"], r["first"], r["last"], r["forced"]) for r in found.collect()) == [e[:6] for e in want]
    frames = table.withColumn("frame", F.expr("cast(round((unix_micros(at) - unix_micros(timestamp'2024-01-01T00:00:00Z')) / 32000) as long)"))
    sound = {(r["key"], r["frame"]): bytes(r["audio"]) for r in listen.audio(found, frames, ["key"]).collect()}
    assert sound == {(e[0], e[1]): e[6] for e in want if e[2] == "utterance"}


@pytest.mark.parametrize("pieces", [1, 7])
def test_stream_equals_the_machine_whatever_the_micro_batches(spark, rows, tmp_path, pieces):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        size = -(-600 // pieces)
        for n in range(pieces):
            part = [r for k in ("left", "right") for r in [x for x in rows if x[0] == k][n * size : (n + 1) * size]]
            spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n:02d}")
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = listening.turns(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        got = sorted((r["key"], r["frame"], r["kind"], r["first"], r["last"], r["forced"], r["audio"] and bytes(r["audio"])) for r in spark.read.schema(listening.OUT).parquet(f"{tmp_path}/out").collect())
        assert got == expected(rows)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_key_that_goes_silent_is_closed(spark, tmp_path):
    """Its open utterance comes out once the watermark has passed the timer."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        start = datetime(2024, 1, 1, tzinfo=timezone.utc)
        parts = [[("gone", start + timedelta(milliseconds=32 * i), bytes([i]), *LOUD) for i in range(20)]] + [[("there", start + timedelta(seconds=60 * n), b"", *QUIET)] for n in (1, 2, 3)]
        for n, part in enumerate(parts):
            spark.createDataFrame(part, SHAPE).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        listening.turns(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        (row,) = spark.read.schema(listening.OUT).parquet(f"{tmp_path}/out").collect()
        assert (row["key"], row["kind"], row["first"], row["last"], row["forced"], bytes(row["audio"])) == ("gone", "utterance", 0, 19, True, bytes(range(20)))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("size", [1, 7, 50])
def test_hops_run_across_frames(spark, size):
    rng, rows = random.Random(2), []
    for k in "ab":
        rows += [(k, i, [rng.random() for _ in range(rng.choice([0, 1, 5, 30]))]) for i in range(60)]
    got = listen.hops(spark.createDataFrame(rows, "k string, i int, v array<double>").repartition(4), ["k"], ["i"], "v", size)
    for k in "ab":
        whole = [x for kk, _, v in rows if kk == k for x in v]
        own = {r["hop"]: r["values"] for r in got.filter(F.col("k") == k).collect()}
        assert own == {h: whole[h * size : (h + 1) * size] for h in range(len(whole) // size)}
