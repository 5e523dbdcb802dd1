"""Commits: old or new after a crash between any two steps, repeated batches, damaged and foreign versions."""

import pytest
from pyspark.sql import functions as F

from weftline.sources import versions

SHAPE = "k string, v int"


def rows(spark, path, **more):
    return sorted(tuple(r) for r in versions.read(spark, path, SHAPE, **more).collect())


def test_a_crash_leaves_the_old_version_or_the_new_one(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    old, new = (spark.createDataFrame([(x, 1)], SHAPE) for x in ("old", "new"))
    assert rows(spark, path) == [] and versions.versions(spark, path) == []
    versions.replace(old, path)

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    for step in ("write", "claim"):
        with monkeypatch.context() as patched:
            patched.setattr(versions._Store, step, crash)
            with pytest.raises(Crash):
                versions.replace(new, path)
        assert rows(spark, path) == [("old", 1)]
    with monkeypatch.context() as patched:  # after the rename, before the caller learns of it
        claim = versions._Store.claim
        patched.setattr(versions._Store, "claim", lambda *a: (claim(*a), crash()))
        with pytest.raises(Crash):
            versions.replace(new, path, batch=("b", 1))
    assert rows(spark, path) == [("new", 1)]
    assert versions.replace(new, path, batch=("b", 1)) is False
    assert rows(spark, path, number=1) == [("old", 1)]
    versions.clear(spark, path)
    assert rows(spark, path) == [("new", 1)] and versions.versions(spark, path) == [2]
    assert sum(p.name.startswith("v-") for p in (tmp_path / "t").iterdir()) == 1


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    path, df = f"{tmp_path}/t", spark.createDataFrame([("a", 1)], SHAPE)
    versions.append(df, path)
    stale = versions._latest(versions._Store(spark, path))
    versions.append(df, path)
    monkeypatch.setattr(versions, "_latest", lambda store: stale)
    with pytest.raises(Exception, match="(?i)exist"):
        versions.append(df, path)
    monkeypatch.undo()
    assert rows(spark, path) == [("a", 1)] * 2


def test_batches_are_added_once_and_shapes_do_not_mix(spark, tmp_path):
    path = f"{tmp_path}/t"
    for number in (0, 1, 1, 0, 2):
        versions.append(spark.createDataFrame([("a", number)], SHAPE), path, batch=("in", number))
    versions.append(spark.createDataFrame([("b", 0)], SHAPE), path, batch=("other", 0))
    assert rows(spark, path) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert rows(spark, path, shape=2) == []
    with pytest.raises(ValueError, match="shape"):
        versions.append(spark.createDataFrame([("b", 0)], SHAPE), path, shape=2)
    (last,) = [p for p in (tmp_path / "t/_commits").iterdir() if p.name.endswith("4") and not p.name.startswith(".")]
    last.write_bytes(b"{ torn")
    assert rows(spark, path) == [("a", 0), ("a", 1), ("a", 2)]


def test_a_stream_that_is_delivered_twice(spark, tmp_path):
    spark.range(10).select(F.lit("s").alias("k"), F.col("id").cast("int").alias("v")).write.parquet(f"{tmp_path}/in")
    for attempt in range(2):  # the second run has lost its checkpoint and delivers batch 0 again
        stream = spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(versions.batches_into(f"{tmp_path}/t", "s")).option("checkpointLocation", f"{tmp_path}/c{attempt}").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark, f"{tmp_path}/t") == [("s", i) for i in range(10)]
