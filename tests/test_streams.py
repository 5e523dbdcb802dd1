"""Streams agree with their batch twins."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import folds
from weftline.streaming import machines, windows


@pytest.fixture
def rows(spark):
    made = [(u, float(t), (u * 7 + t * 3) % 5 != 0) for u in range(3) for t in range(30)]
    return spark.createDataFrame(made, "user long, at double, ok boolean")


@pytest.mark.parametrize("make,column,made", [(lambda: folds.RateLimit(3, 10.0), "at", "admitted boolean"), (lambda: folds.Streak(), "ok", "streak long, used boolean"), (lambda: folds.DriftingBaseline(5, 2, 1.0, 2), "at", "z double, reset boolean")])
def test_stream_of_many_batches_equals_batch(spark, tmp_path, rows, make, column, made):
    for i in range(3):  # three files, three micro-batches in order
        rows.filter((F.col("at") >= i * 10) & (F.col("at") < i * 10 + 10)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = windows.drained(machines.streamed_fold(stream, ["user"], ["at"], [column], make, made, ["at"]), "append")
    want = folds.ordered_fold(rows, ["user"], ["at"], [column], make, made, ["at"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_duplicates_within_the_watermark_drop_out(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:00:00")], "event_id long, t string").select("event_id", F.to_timestamp("t").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{tmp_path}/in")
    assert sorted(r["event_id"] for r in windows.drained(windows.deduplicated(stream), "append").collect()) == [1, 2]
