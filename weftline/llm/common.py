"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.base import spread, table
from ..sources.shared import cut, drop_path, shared_dir, shared_path

__all__ = ["SLICE", "SMALL", "cut", "drop_path", "map_slices", "release", "shared_dir", "shared_path", "small", "small_batches", "spread", "table", "utf8", "word_count"]

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
#: bytes.split() without arguments splits UTF-8 at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Rows that one call of a row function sees at most; a slice of an Arrow batch, so that texts of
#: many megabytes do not become Python objects all at once.
SLICE = 512
#: Rows of an Arrow batch at most. Spark's 10,000 rows of text would be tens of megabytes outside the heap, several times over.
BATCH, BATCH_CONF = 2048, "spark.sql.execution.arrow.maxRecordsPerBatch"


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_count(text: Column) -> Column:
    """Number of words of a text column, null: 0, without leaving the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH rows. Plans are run later, so the session keeps them."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH:
        spark.conf.set(BATCH_CONF, str(BATCH))


def map_slices(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """A row-wise Arrow map: rows gets the columns of at most SLICE rows as lists and returns those of schema."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                got = rows(batch.slice(at, SLICE).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Lets the driver's JVM collect what no one refers to any more; Spark's cleaner then deletes the shuffle files and
    checkpoints of such plans, which in a job of many steps would stay to its end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows up to which a side table, counted first, is broadcast; a larger one is joined by shuffle.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """df materialised in the shared folder and marked for broadcast if its counted rows are at most SMALL."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= SMALL else kept
