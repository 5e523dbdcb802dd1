"""Tables as they come: Parquet, JSON lines (also gzipped), CSV, one JSON list; tolerant logs; listings; sinks."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import ranges, scans, versions

FORMATS = {"parquet": ("parquet", {}), "jsonl": ("json", {}), "jsonl.gz": ("json", {}), "csv": ("csv", {"header": True, "multiLine": True, "escape": '"'}), "json": ("json", {"multiLine": True})}


def listed(spark: SparkSession, directory: str, prefix: str = "", recursive: bool = False) -> list[str]:
    """Paths of the tables in a directory, sorted, through Hadoop; hidden files and folders are left out."""
    root = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: list[str] = []

    def walk(path) -> None:
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith((".", "_")):
                continue
            if status.isDirectory():
                if recursive:
                    walk(status.getPath())
            elif name.startswith(prefix) and any(name.endswith(f".{suffix}") for suffix in FORMATS):
                found.append(status.getPath().toString())

    if fs.exists(root):
        walk(root)
    return sorted(found)


def shards(spark: SparkSession, root: str, split: str | None = None) -> list[str]:
    """Parquet shards below root; those of a split where any are named after it, else all."""
    every = [p for p in listed(spark, root, recursive=True) if p.endswith(".parquet")]
    own = [p for p in every if split and fnmatch.fnmatch(p.rsplit("/", 1)[-1], f"{split}-*.parquet")]
    return own or every


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One table by its suffix."""
    suffix = next(s for s in sorted(FORMATS, key=len, reverse=True) if path.endswith(f".{s}"))
    kind, options = FORMATS[suffix]
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def read_tables(spark: SparkSession, directory: str, schema: StructType | str, prefix: str = "") -> DataFrame:
    """All tables of a directory under one schema; columns that a table lacks are null. No inference pass."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = None
    for path in listed(spark, directory, prefix):
        part = read_table(spark, path, wanted if not path.endswith((".parquet", ".csv")) else None)
        part = part.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in part.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], wanted)


def drifting(spark: SparkSession, paths: Sequence[str], wanted: dict[str, Sequence[str]], limit: int | None = None) -> DataFrame:
    """Shards of differing schemas: each wanted column is the first of its candidates that a shard has (null
    otherwise). Only these columns are read, in one scan for each schema; a shard that cannot be read gives no rows
    (scans.first_columns names it and its reason)."""
    out, _ = scans.first_columns(spark, paths, wanted)
    return out.limit(limit) if limit is not None else out


def json_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A log of JSON lines: lines that do not parse are skipped, as the last one after a crash; no file, no rows."""
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], shape)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", shape, {"mode": "PERMISSIVE"}).alias("row"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.filter("ok and row is not null").select("row.*")


def located(df: DataFrame) -> DataFrame:
    """df with file_path and row_index, the place of each row, for reading it again later."""
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def resumed(df: DataFrame, order: Sequence[str], done: int) -> DataFrame:
    """df without its first rows in order, ordered: for tables that have an order but no lines; ranges.resumed_lines starts in the
    middle of files of lines."""
    return df.orderBy(*order).offset(done)


def shuffled(df: DataFrame, seed: int, identity: Sequence[str]) -> DataFrame:
    """df in a global order that depends on the seed only: an external sort by a hash."""
    return df.withColumn("_o", F.sha2(F.concat_ws("|", F.lit(str(seed)), *identity), 256)).orderBy("_o").drop("_o")


MEDIA = (".wav", ".flac", ".mp3")


def media_names(spark: SparkSession, root: str) -> DataFrame:
    """path and name of every media file below root that is not empty; where there are none, of the members of the archives there
    (path: archive::member), which are read as a stream on the executors."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{wav,flac,mp3}").load(root)
    files = listing.select("path").withColumn("name", F.element_at(F.split("path", "/"), -1))
    if not files.isEmpty():
        return files
    inside = ranges.member_names(spark, root)
    return inside.filter(F.lower("name").rlike("[.](" + "|".join(m[1:] for m in MEDIA) + ")$"))


def digests(spark: SparkSession, root: str) -> DataFrame:
    """path, name, bytes and SHA-256 of every file below root, of any size; where only Spark opens the store, files are
    read whole, which ends at 2 GB."""
    if ranges.reachable(root):
        return ranges.file_digests(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(receipts: DataFrame, files: DataFrame) -> DataFrame:
    """Each receipt (name, sha256) with ok, missing or mismatch; a receipt that is no SHA-256 asks for presence only."""
    found = files.groupBy("name").agg(F.max("sha256").alias("found"))
    exact = F.col("sha256").rlike("^[0-9a-f]{64}$")
    status = F.when(F.col("found").isNull(), "missing").when(exact & (F.col("sha256") != F.col("found")), "mismatch").otherwise("ok")
    return receipts.join(found, "name", "left").withColumn("status", status).drop("found")


def write_split(df: DataFrame, path: str, by: str = "split") -> None:
    """Records as JSON lines in a folder for each side; Spark's commit makes them appear at once."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def snapshot(df: DataFrame, path: str, version: int) -> None:
    """State with its version; read_snapshot gives it back only under that version. It is committed at once: a crash leaves
    the state before."""
    versions.replace(df, path, version)


def read_snapshot(spark: SparkSession, path: str, schema: StructType | str, version: int) -> DataFrame:
    return versions.read(spark, path, schema, version)
