"""The folder that driver and executors share (spark.checkpoint.dir), and what is kept there between jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder; only where neither is set and the master is this machine
    (tests), a temporary one. On a cluster executors would not see that."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        import tempfile

        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path below shared_dir through Hadoop, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Hadoop, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def named_parts(spark: SparkSession, written: str, folder: str, name: str) -> None:
    """Moves the part files that Spark has written into a folder under names of their own ({} is their number)."""
    paths = spark._jvm.org.apache.hadoop.fs
    at = paths.Path(written)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(paths.Path(folder))
    for i, part in enumerate(p for p in files.listStatus(at) if p.getPath().getName().startswith("part-")):
        files.rename(part.getPath(), paths.Path(f"{folder}/{name.format(i)}"))
    files.delete(at, True)
