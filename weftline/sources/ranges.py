"""Data sources that read parts of files: lines from any byte on, names inside archives, digests of files of any size.

Spark's own readers begin a file at its start and hand over a binary file whole. These sources plan byte ranges (or one
file) a task and read them piece by piece, so a table of any length is read from line n on without what lies before it, and an
archive or a file is held in memory by its next piece only:

* ``weftline_lines``: path, offset and value of every line; a line belongs to the range in which it begins;
* ``weftline_members``: path (archive::member) and name of the members of tar archives, gzipped or not;
* ``weftline_digests``: path, name, bytes and SHA-256 of files, or of the files of a folder one behind the other. A SHA-256 has no way to begin in the
  middle, so one task reads all of it, in pieces.

Paths are what ``pyarrow.fs`` opens, on the driver and in the tasks alike: local folders that all machines share, hdfs, s3, gs
and the like. Options: ``path`` (a file or folder, looked through to any depth), ``suffixes`` (comma-separated), ``range_bytes``,
and for lines ``from_path`` and ``from_offset``, where reading starts, ``to_offset``, where it ends in that file, and ``blank`` (false:
lines of white space only are passed over)."""

from __future__ import annotations

import hashlib
import tarfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

RANGE_BYTES, PIECE, ROWS = 64 << 20, 1 << 20, 4096


@dataclass
class Part(InputPartition):
    """Bytes start to stop of a file."""

    path: str
    start: int
    stop: int


def reachable(path: str) -> bool:
    """Whether these sources can open the path at all; some stores only Spark can."""
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def files(path: str, suffixes: Sequence[str] = ()) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below a path with one of the suffixes, sorted by path; hidden ones are left out."""
    store, base = fs.FileSystem.from_uri(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        return []
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    prefix = path[: path.index(base)] if base in path else ""  # scheme and host
    shown = lambda p: not any(x.startswith((".", "_")) for x in p[len(base) :].split("/"))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and (f is info or shown(f.path)) and (not suffixes or f.path.endswith(tuple(suffixes))))


def opened(path: str, compression: str | None = None) -> BinaryIO:
    """A file to seek in, or the stream of a compressed one."""
    store, base = fs.FileSystem.from_uri(path)
    return store.open_input_file(base) if compression is None else store.open_input_stream(base, compression=compression)


def planned(found: Sequence[tuple[str, int]], range_bytes: int, from_path: str = "", from_offset: int = 0) -> list[Part]:
    """Ranges of the files, from a place on; a gzipped file is one range."""
    out = []
    for path, size in found:
        if path < from_path:
            continue
        at = from_offset if path == from_path else 0
        if path.endswith(".gz"):
            out.append(Part(path, at, size if at < size else at + 1))
            continue
        out += [Part(path, a, min(size, a + range_bytes)) for a in range(at, size, range_bytes)]
    return out


def lines_of(part: Part) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of the lines that begin in the part; offsets of a gzipped file are those of its text."""
    gzipped = part.path.endswith(".gz")
    with opened(part.path, "gzip" if gzipped else None) as file:
        at, rest, skip = 0, b"", False
        if gzipped:
            stop = None
            while at < part.start:  # a compressed file has no other way to its middle
                got = file.read(min(PIECE, part.start - at))
                if not got:
                    return
                at += len(got)
        else:
            stop = part.stop
            if part.start:
                file.seek(part.start - 1)
                at, skip = part.start - 1, True  # the line before may end right here
        pieces: list[bytes] = []
        start = at
        while True:
            got = file.read(PIECE)
            if not got:
                break
            *full, rest = got.split(b"\n")
            for piece in full:
                line = b"".join([*pieces, piece]) if pieces else piece
                pieces = []
                if not skip:
                    yield start, line
                skip, start = False, start + len(line) + 1
                if stop is not None and start >= stop:
                    return
            if rest:
                pieces.append(rest)
        if pieces and not skip:
            yield start, b"".join(pieces)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.suffixes = tuple(x for x in options.get("suffixes", "").split(",") if x)

    def partitions(self) -> list[Part]:
        return [Part(path, 0, size) for path, size in files(self.options["path"], self.suffixes)]

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if part is None else self.batches(part)  # Spark plans one task without a part where there are none


class _LineReader(_Reader):
    def partitions(self) -> list[Part]:
        found, path, offset = files(self.options["path"], self.suffixes), self.options.get("from_path", ""), int(self.options.get("from_offset", 0))
        if "to_offset" in self.options:
            return [Part(path, offset, int(self.options["to_offset"]))]
        return planned(found, int(self.options.get("range_bytes", RANGE_BYTES)), path, offset)

    def batches(self, part: Part) -> Iterator[pa.RecordBatch]:
        offsets, values, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part.path] * len(values), pa.string()), pa.array(offsets, pa.int64()), pa.array(values, pa.binary())], names=["path", "offset", "value"])

        blank = self.options.get("blank", "true") == "true"
        for offset, line in lines_of(part):
            if not blank and not line.strip():
                continue
            offsets.append(offset)
            values.append(line)
            held += len(line)
            if len(values) >= ROWS or held >= PIECE:
                yield batch()
                offsets, values, held = [], [], 0
        if values:
            yield batch()


class _MemberReader(_Reader):
    def batches(self, part: Part) -> Iterator[pa.RecordBatch]:
        paths, names = [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.string())], names=["path", "name"])

        try:
            zipped = part.path.endswith(("gz", "tgz"))
            # A plain archive is read header by header and its contents are sought over; a gzipped one passes by.
            with opened(part.path, "gzip" if zipped else None) as file, tarfile.open(fileobj=file, mode="r|" if zipped else "r:") as tar:
                while (member := tar.next()) is not None:
                    if member.isfile():
                        paths.append(f"{part.path}::{member.name}")
                        names.append(member.name.rsplit("/", 1)[-1])
                    tar.members.clear()  # tarfile would keep them all
                    if len(paths) >= ROWS:
                        yield batch()
                        paths, names = [], []
        except (tarfile.TarError, OSError, EOFError):
            pass  # what was readable up to there
        if paths:
            yield batch()


class _DigestReader(_Reader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.folders = options.get("folders", "false") == "true"

    def partitions(self) -> list[Part]:
        if not self.folders:
            return super().partitions()
        sizes: dict[str, int] = {}
        for path, size in files(self.options["path"], self.suffixes):
            folder = path.rsplit("/", 1)[0]
            sizes[folder] = sizes.get(folder, 0) + size
        return [Part(folder, 0, size) for folder, size in sizes.items()]

    def batches(self, part: Part) -> Iterator[pa.RecordBatch]:
        whole, size = hashlib.sha256(), 0
        inside = [path for path, _ in files(part.path, self.suffixes) if path.rsplit("/", 1)[0] == part.path] if self.folders else [part.path]
        for path in inside:
            with opened(path) as file:
                while got := file.read(PIECE):
                    whole.update(got)
                    size += len(got)
        name = part.path.rsplit("/", 1)[-1]
        yield pa.RecordBatch.from_pydict({"path": [part.path], "name": [name], "bytes": [size], "sha256": [whole.hexdigest()]})


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weftline_lines"

    def schema(self) -> str:
        return "path string, offset long, value binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LineReader(dict(self.options))


class MemberSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weftline_members"

    def schema(self) -> str:
        return "path string, name string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MemberReader(dict(self.options))


class DigestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weftline_digests"

    def schema(self) -> str:
        return "path string, name string, bytes long, sha256 string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _DigestReader(dict(self.options))


def load(spark: SparkSession, source: type[DataSource], path: str, **options: object) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()}).load(path)


def read_lines(spark: SparkSession, path: str, suffixes: Sequence[str] = (), range_bytes: int = RANGE_BYTES, **place: object) -> DataFrame:
    """path, offset and value (bytes) of the lines of all files at or below path, in order of path and offset inside a
    partition and from one partition to the next."""
    return load(spark, LineSource, path, suffixes=",".join(suffixes), range_bytes=range_bytes, **place)


def line_index(spark: SparkSession, path: str, suffixes: Sequence[str] = (), every: int = RANGE_BYTES) -> DataFrame:
    """path, offset (of the first line that begins in it), lines and before of every range of ``every`` bytes that has lines that are
    not blank: a sparse index, one row a range, of lines in the order of path and offset. before counts the lines of all
    ranges ahead of it. Written as a table, it serves any number of readers."""
    rows = read_lines(spark, path, suffixes, max(every, RANGE_BYTES // 4), blank="false")  # a task reads many ranges of the index
    ranges = rows.groupBy("path", F.floor(F.col("offset") / every).alias("_range")).agg(F.min("offset").alias("offset"), F.count("*").alias("lines"))
    # One row a range: a running count over files and, inside a file, over its ranges.
    totals = ranges.groupBy("path").agg(F.sum("lines").alias("_lines"))
    by_file = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("path", F.coalesce(F.sum("_lines").over(by_file), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_inside", F.coalesce(F.sum("lines").over(inside), F.lit(0))).join(ahead, "path").select("path", "offset", "lines", (F.col("_ahead") + F.col("_inside")).alias("before"))


def resumed_lines(spark: SparkSession, path: str, index: DataFrame, done: int, suffixes: Sequence[str] = (), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, offset and value of the lines that are not blank after the first ``done`` of them. Files and ranges before the
    one in which line ``done`` begins are not opened; of that range, the lines before it are passed over."""
    at = index.filter((F.col("before") <= done) & (F.col("before") + F.col("lines") > done)).first()
    if at is None:
        return spark.createDataFrame([], LineSource({}).schema())
    start = at["offset"]
    if skip := done - at["before"]:
        # The lines of that one range, up to where the next one begins.
        end = index.filter((F.col("path") == at["path"]) & (F.col("offset") > start)).agg(F.min("offset")).first()[0]
        only = {} if end is None else {"to_offset": end}
        rows = read_lines(spark, path, suffixes, range_bytes, blank="false", from_path=at["path"], from_offset=start, **only)
        start = rows.filter(F.col("path") == at["path"]).select("offset").orderBy("offset").limit(skip + 1).agg(F.max("offset")).first()[0]
    return read_lines(spark, path, suffixes, range_bytes, blank="false", from_path=at["path"], from_offset=start)


def member_names(spark: SparkSession, path: str, suffixes: Sequence[str] = (".tar", ".tar.gz", ".tgz")) -> DataFrame:
    """path (archive::member) and name of the files inside the archives at or below path; a broken archive gives those
    that can be read."""
    return load(spark, MemberSource, path, suffixes=",".join(suffixes))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, name, bytes and SHA-256 of the files at or below path."""
    return load(spark, DigestSource, path)


def folder_digests(spark: SparkSession, path: str, suffixes: Sequence[str] = ()) -> DataFrame:
    """path, name, bytes and SHA-256 of every folder at or below path that holds files: of these files, in order of their names, one behind
    the other, as of a table that Spark has written in parts."""
    return load(spark, DigestSource, path, suffixes=",".join(suffixes), folders="true")
