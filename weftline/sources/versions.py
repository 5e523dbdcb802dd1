"""Tables that change by commits: a crash between any two steps leaves the old version or the new one.

A commit writes rows into a folder of its own, and then one small file, ``_commits/<number>``, that lists the folders of the
version. The file is written under another name and renamed to a number that no one has taken yet; until then readers see the
version before, and of two writers one fails. Rows that come with a name and a number of their batch are added once: the commit
remembers the last number of each name, so a batch that is written again after a crash, or by a retry, changes nothing."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

COMMITS = "_commits"


class _Store:
    """Files of a folder through Hadoop, whatever store it is in."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(path).toUri(), spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> Any:
        return self.fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"))

    def names(self, folder: str) -> list[str]:
        at = self.at(folder) if folder else self.fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(self.root))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def claim(self, made: str, name: str) -> None:
        """Renames a file to a name that must be free."""
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        self.context.rename(self.at(made), self.at(name), self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 0))

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _latest(store: _Store) -> tuple[int, dict]:
    """Number and content of the last commit that can be read; 0 and an empty table without one."""
    for name in sorted((n for n in store.names(COMMITS) if n.isdigit()), reverse=True):
        try:
            return int(name), json.loads(store.read(f"{COMMITS}/{name}"))
        except ValueError:
            continue  # a damaged file: the version before it counts
        except Py4JJavaError as error:
            if "ChecksumException" not in str(error):
                raise
    return 0, {"folders": [], "batches": {}, "shape": None}


def _commit(df: DataFrame, path: str, shape: int, batch: tuple[str, int] | None, keep: bool) -> bool:
    spark = df.sparkSession
    store = _Store(spark, path)
    number, before = _latest(store)
    if batch is not None and before["batches"].get(batch[0], -1) >= batch[1]:
        return False
    if keep and before["folders"] and before["shape"] != shape:
        raise ValueError(f"rows of shape {shape} do not go with a table of shape {before['shape']}")
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{folder}")
    content = {
        "folders": [*(before["folders"] if keep else []), folder], "shape": shape,
        "batches": before["batches"] | ({batch[0]: batch[1]} if batch is not None else {}),
    }
    _publish(store, number + 1, content)
    return True


def _publish(store: _Store, number: int, content: dict) -> None:
    made = f"{COMMITS}/.{uuid.uuid4().hex}"
    store.write(made, json.dumps(content))
    store.claim(made, f"{COMMITS}/{number:020d}")


def replace(df: DataFrame, path: str, shape: int = 1, batch: tuple[str, int] | None = None) -> bool:
    """The rows of df are the next version of the table, of the shape's number; False if the batch was there already."""
    return _commit(df, path, shape, batch, keep=False)


def append(df: DataFrame, path: str, shape: int = 1, batch: tuple[str, int] | None = None) -> bool:
    """The rows of df are added to the table in its next version; False if the batch was there already."""
    return _commit(df, path, shape, batch, keep=True)


def read(spark: SparkSession, path: str, schema: StructType | str, shape: int = 1, number: int | None = None) -> DataFrame:
    """The last version (or that of a number); no rows where there is none, or one of another shape."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    store = _Store(spark, path)
    content = _latest(store)[1] if number is None else json.loads(store.read(f"{COMMITS}/{number:020d}"))
    if content["shape"] != shape or not content["folders"]:
        return spark.createDataFrame([], wanted)
    return spark.read.schema(wanted).parquet(*[f"{path.rstrip('/')}/{f}" for f in content["folders"]])


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in _Store(spark, path).names(COMMITS) if n.isdigit()]


def clear(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Deletes all versions but the last ones, and folders that no commit lists. Not to be run while someone writes."""
    store = _Store(spark, path)
    numbers = versions(spark, path)
    kept = numbers[-keep:]
    for n in numbers[:-keep]:
        store.drop(f"{COMMITS}/{n:020d}")
    listed = {f for n in kept for f in json.loads(store.read(f"{COMMITS}/{n:020d}"))["folders"]}
    for name in store.names(""):
        if name.startswith("v-") and name not in listed:
            store.drop(name)


def batches_into(path: str, name: str, shape: int = 1):
    """A function for ``foreachBatch`` that adds each micro-batch once, however often it is delivered."""

    def write(batch: DataFrame, number: int) -> None:
        append(batch, path, shape, (name, number))

    return write
