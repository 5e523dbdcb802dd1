"""Lines from any byte on, names in archives, digests in pieces, scans of drifting and broken files."""

import gzip
import hashlib
import io
import random
import subprocess
import sys
import tarfile
from pathlib import Path

import pytest

from weftline.sources import ranges, scans, speech, tables


def written(tmp_path, seed, end=b"\n"):
    """Files of lines, some long, some blank; all lines that are not blank in order of path and offset."""
    rng, every = random.Random(seed), []
    for name in ("a.jsonl", "b/c.jsonl", "b/d.jsonl.gz", "e.jsonl"):
        lines = [rng.choice([b"", b"  ", b'{"x": %d}' % i, "é".encode() * rng.randrange(400), b"\r"]) for i in range(rng.randrange(1, 120))]
        if seed == 3 and name == "a.jsonl":
            lines.append(b"y" * (3 << 20))  # longer than a piece
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes((gzip.compress if name.endswith("gz") else bytes)(b"\n".join(lines) + end))
        every += [(str(path), line) for line in lines if line.strip()]
    (tmp_path / "_hidden.jsonl").write_bytes(b"no\n")
    return every


@pytest.mark.parametrize(("seed", "every"), [(1, 64), (2, 1000), (3, 7777)])
def test_lines_of_any_ranges_and_from_any_line(spark, tmp_path, seed, every):
    want = written(tmp_path, seed, b"\n" if seed != 2 else b"")
    rows = lambda df: [(r["path"], bytes(r["value"])) for r in df.collect()]
    assert rows(ranges.read_lines(spark, str(tmp_path), range_bytes=every, blank="false")) == want
    index = ranges.line_index(spark, str(tmp_path), every=every)
    index.write.parquet(f"{tmp_path}/_index")
    index = spark.read.parquet(f"{tmp_path}/_index")
    assert index.agg({"lines": "sum"}).first()[0] == len(want)
    for done in (0, 1, len(want) // 3, len(want) // 2, len(want) - 1, len(want), len(want) + 5):
        assert rows(ranges.resumed_lines(spark, str(tmp_path), index, done, range_bytes=every)) == want[done:], done


def test_what_lies_before_is_not_opened(spark, tmp_path):
    want = written(tmp_path, 1)
    index = spark.createDataFrame(ranges.line_index(spark, str(tmp_path), every=200).collect())
    (tmp_path / "a.jsonl").write_bytes(b"gone\n" * 3)
    first = sum(p.endswith("/a.jsonl") for p, _ in want)
    got = ranges.resumed_lines(spark, str(tmp_path), index, first + 2).collect()
    assert [(r["path"], bytes(r["value"])) for r in got] == want[first + 2 :]


def test_archives_are_listed_without_their_contents(spark, tmp_path):
    for name, mode in (("x.tar", "w"), ("y.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as tar:
            for i in range(300):
                info = tarfile.TarInfo(f"deep/{'n' * 120}/{i}.wav")
                info.size = i
                tar.addfile(info, io.BytesIO(b"z" * i))
            folder = tarfile.TarInfo("deep/more")
            folder.type = tarfile.DIRTYPE
            tar.addfile(folder)
    (tmp_path / "broken.tar.gz").write_bytes((tmp_path / "y.tar.gz").read_bytes()[:900])
    got = [r for r in ranges.member_names(spark, str(tmp_path)).collect() if "broken" not in r["path"]]
    assert sorted(r["path"] for r in got) == sorted(f"{tmp_path}/{a}::deep/{'n' * 120}/{i}.wav" for a in ("x.tar", "y.tar.gz") for i in range(300))
    assert {r["name"] for r in got} == {f"{i}.wav" for i in range(300)}
    assert tables.media_names(spark, str(tmp_path)).count() >= 600


def test_memory_does_not_grow_with_an_archive_or_a_file(tmp_path):
    """A sparse archive of 6 GB is listed, and a sparse file of 1 GB digested, by a process of 1.5 GB."""
    member = tarfile.TarInfo("big.wav")
    member.size = 3 << 30
    with open(tmp_path / "big.tar", "wb") as f:
        for _ in range(2):
            f.write(member.tobuf(tarfile.GNU_FORMAT))
            f.seek(member.size, 1)
        f.write(b"\0" * 1024)
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(1 << 30)
    code = f"""
import resource; resource.setrlimit(resource.RLIMIT_DATA, (1500 << 20, 1500 << 20))
from weftline.sources import ranges
r = ranges._MemberReader({{}}); p = {str(tmp_path)!r}
print(sum(b.num_rows for b in r.read(ranges.Part(p + "/big.tar", 0, 0))))
print(next(ranges._DigestReader({{}}).read(ranges.Part(p + "/big.bin", 0, 0))).to_pydict()["sha256"][0])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120, cwd=Path(ranges.__file__).parents[2]).stdout.split()
    zeros = hashlib.sha256()
    for _ in range(1 << 10):
        zeros.update(b"\0" * (1 << 20))
    assert out == ["2", zeros.hexdigest()]


def test_digests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.bin").write_bytes(b"abc")
    (tmp_path / "y.bin").write_bytes(b"")
    got = {(r["name"], r["bytes"], r["sha256"]) for r in ranges.file_digests(spark, str(tmp_path)).collect()}
    assert got == {(n, len(b), hashlib.sha256(b).hexdigest()) for n, b in (("x.bin", b"abc"), ("y.bin", b""))}
    assert ranges.file_digests(spark, f"{tmp_path}/none").count() == 0 and not ranges.reachable("odd://x/y")


def shards(spark, tmp_path):
    """Seven files: three schemas, one without a footer, one cut off in its pages."""
    rows = lambda *names: spark.createDataFrame([tuple(f"{n}{i}" for n in names) for i in range(5)], ", ".join(f"{n} string" for n in names))
    (tmp_path / "s").mkdir()
    for i, names in enumerate([("text", "who"), ("text", "who"), ("sentence", "who", "extra"), ("text", "who"), ("sentence", "other")]):
        rows(*names).coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        (part,) = (tmp_path / f"w{i}").glob("*.parquet")
        part.rename(tmp_path / f"s/train-{i}.parquet")
    (tmp_path / "s/train-5.parquet").write_bytes((tmp_path / "s/train-0.parquet").read_bytes()[:200])
    (tmp_path / "s/train-6.parquet").write_bytes(b"")
    return [f"{tmp_path}/s/train-{i}.parquet" for i in range(7)]


def test_scans_survive_broken_files_and_are_grouped_by_schema(spark, tmp_path):
    paths = shards(spark, tmp_path)
    got, broken = scans.first_columns(spark, paths, {"text": ("text", "sentence"), "who": ("who",)})
    assert sorted(((r["text"], r["who"]) for r in got.collect()), key=str) == sorted([(f"text{i}", f"who{i}") for i in range(5)] * 3 + [(f"sentence{i}", f"who{i}") for i in range(5)] + [(f"sentence{i}", None) for i in range(5)], key=str)
    assert {r["path"][-9:-8] for r in broken.collect()} == {"5", "6"} and all(r["reason"] for r in broken.collect())
    told = scans.footers(spark, paths).collect()
    assert sorted(map(len, scans.by_schema(told, {"text", "sentence", "who"}.__contains__).values())) == [1, 1, 3]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 3
    assert tables.drifting(spark, paths[5:], {"text": ("text",)}).count() == 0 and tables.drifting(spark, [], {"text": ("text",)}).columns == ["text"]
    assert {r["rows"] for r in told} == {5, None}


def test_an_index_names_shards_that_cannot_be_read(spark, tmp_path):
    shards(spark, tmp_path)
    found = speech.index(spark, speech.Corpus("k", "text", "who", None, "audio", ("sentence",)), f"{tmp_path}/s")
    reasons = {(r["shard"], r["skip_reason"]): r["count"] for r in found.groupBy("shard", "skip_reason").count().collect()}
    assert reasons == {**{(f"train-{i}.parquet", "missing_column"): 5 for i in range(5)}, **{(f"train-{i}.parquet", "unusable_shard"): 1 for i in (5, 6)}}


def test_rows_that_a_file_breaks_off_before_are_counted(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "s").mkdir()
    spark.range(0, 50_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).write.option("parquet.block.size", 1 << 18).parquet(f"{tmp_path}/w")
    (part,) = (tmp_path / "w").glob("*.parquet")
    whole = bytearray(part.read_bytes())
    (tmp_path / "s/good.parquet").write_bytes(whole)
    whole[len(whole) // 2 : len(whole) // 2 + 20_000] = b"\xff" * 20_000
    (tmp_path / "s/torn.parquet").write_bytes(whole)
    rows, told = scans.scan(spark, [f"{tmp_path}/s/good.parquet", f"{tmp_path}/s/torn.parquet"], {"text"}, lambda df, have: df.select(F.col("_metadata.file_name").alias("shard"), F.length("text").alias("n")))
    (lost,) = scans.unread(rows.filter("n > 0"), told).collect()
    assert lost["path"].endswith("torn.parquet") and lost["reason"] == "breaks off" and 0 < lost["lost"] <= 50_000
