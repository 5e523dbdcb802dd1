"""Scans of many Parquet files that differ in their columns and may be broken.

Footers are read in the tasks, so that a broken file is a row with its reason and not the end of the job. Files of one
schema are one scan: a listing of any number of files is as many branches as it has different schemas. Files that break off in
the middle show by their count of rows, which the footer tells ahead."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import files, opened, reachable

FOOTER = "path string, columns string, rows long, reason string"
FILES_A_TASK = 64


def _footers(path: str) -> list[tuple[str, str | None, int | None, str | None]]:
    """One row for a file, or for each file of a folder."""
    import pyarrow.parquet as pq

    try:
        inside = files(path, (".parquet",))
    except (pa.ArrowException, OSError) as error:
        return [(path, None, None, f"{type(error).__name__}: {error}"[:200])]
    out = []
    for name, _ in inside or [(path, 0)]:
        try:
            with opened(name) as file, pq.ParquetFile(file) as found:
                schema = found.schema_arrow
                out.append((name, json.dumps([[f.name, str(f.type)] for f in schema]), found.metadata.num_rows, None))
        except (pa.ArrowException, OSError, EOFError, ValueError) as error:
            out.append((name, None, None, f"{type(error).__name__}: {error}"[:200]))
    return out


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, columns (names and types as JSON), rows and reason (null: readable) of every file, those of folders too."""
    if not paths:
        return spark.createDataFrame([], FOOTER)
    if not reachable(paths[0]):
        return spark.createDataFrame([_by_spark(spark, p) for p in paths], FOOTER)
    tasks = max(1, min(len(paths), max(spark.sparkContext.defaultParallelism, len(paths) // FILES_A_TASK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*[row for path in batch.column(0).to_pylist() for row in _footers(path)])) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(got, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["path", "columns", "rows", "reason"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInArrow(run, FOOTER)


def _by_spark(spark: SparkSession, path: str) -> tuple[str, str | None, int | None, str | None]:
    """The same where only Spark opens the store; it does not tell the rows ahead."""
    try:
        return path, json.dumps([[f.name, f.dataType.simpleString()] for f in spark.read.parquet(path).schema]), None, None
    except Exception as error:  # whatever a broken file makes Spark raise
        return path, None, None, f"{type(error).__name__}: {error}"[:200]


def by_schema(told: Sequence, relevant: Callable[[str], bool] = lambda name: True) -> dict[str, list[str]]:
    """Paths of the readable files of each different schema, as far as its columns are relevant."""
    groups: dict[str, list[str]] = {}
    for row in sorted(told, key=lambda r: r["path"]):
        if row["reason"] is None:
            groups.setdefault(json.dumps([c for c in json.loads(row["columns"]) if relevant(c[0])]), []).append(row["path"])
    return groups


def scan(spark: SparkSession, paths: Sequence[str], relevant: set[str], shaped: Callable[[DataFrame, set[str]], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """What shaped makes of the files, and their footers. shaped gets the rows of files that agree in the relevant columns, once
    for each such schema, and the names of the columns there are; all it returns must have the same columns. Data pages that
    cannot be read end their file's rows, see ``unread``. Without a readable file the first is None."""
    told = footers(spark, paths)
    rows = told.collect()  # one a file, as the listing
    told = spark.createDataFrame(rows, FOOTER) if rows else told
    parts = []
    for columns, group in by_schema(rows, relevant.__contains__).items():
        df = spark.read.option("ignoreCorruptFiles", True).parquet(*group)
        parts.append(shaped(df, {name for name, _ in json.loads(columns)}))
    return (reduce(DataFrame.unionByName, parts) if parts else None), told


def unread(rows: DataFrame, told: DataFrame, file: str = "shard") -> DataFrame:
    """path, reason and lost (rows, null if unknown) of the files whose footer cannot be read, or whose rows (counted by file name in
    the column named) are fewer than the footer tells. Rows are counted before any filter."""
    counted = rows.groupBy(F.col(file).alias("_name")).agg(F.count("*").alias("_n"))
    named = told.withColumn("_name", F.element_at(F.split("path", "/"), -1))
    lost = F.col("rows") - F.coalesce("_n", F.lit(0))
    reason = F.coalesce("reason", F.when(lost > 0, F.lit("breaks off")))
    return named.join(counted, "_name", "left").select("path", reason.alias("reason"), lost.alias("lost")).filter("reason is not null")


def first_columns(spark: SparkSession, paths: Sequence[str], wanted: dict[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Files of differing schemas: each wanted column is the first of its candidates that a file has (null otherwise), as
    a string. Only these columns are read. With them, path and reason of the files that cannot be read."""

    def shaped(df: DataFrame, have: set[str]) -> DataFrame:
        pick = {name: next((c for c in candidates if c in have), None) for name, candidates in wanted.items()}
        return df.select(*[(F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")).alias(name) for name, c in pick.items()])

    got, told = scan(spark, paths, {c for candidates in wanted.values() for c in candidates}, shaped)
    if got is None:
        got = spark.createDataFrame([], ", ".join(f"`{name}` string" for name in wanted))
    return got, told.filter("reason is not null").select("path", "reason")
