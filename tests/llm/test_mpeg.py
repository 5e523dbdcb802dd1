import hashlib
import random
import struct
import zlib

import pytest

from weftline.llm import mpeg, queries


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1400, 1416, 1417, 1418, 100_000])
def test_round_trip_and_accounts(n):
    payload = mpeg.padded(random.Random(n).randbytes(n))
    assert len(payload) % 64 == 0 and len(payload) > 0
    data = mpeg.write(payload)
    s = mpeg.parse(data)
    assert s.payload == payload and s.bad_checksums == 0 and s.skipped == 0
    assert (s.told_frames, s.frames) == (s.frames, len(s.offsets)) and s.told_bytes == len(data) - s.offsets[0]
    assert s.samples == 1152 * s.frames and s.hertz == 32000 and len(s.seek) == 100
    assert all(mpeg.header(data[o : o + 4]) for o in s.offsets)


def test_payload_full_of_false_headers():
    payload = mpeg.padded(b"\xff\xfa\xe8\xc0" * 5000)
    assert mpeg.parse(mpeg.write(payload)).payload == payload


def test_resynchronises_behind_junk_and_counts_it():
    payload = mpeg.padded(random.Random(1).randbytes(20_000))
    data = mpeg.write(payload)
    at = mpeg.parse(data).offsets[3]
    s = mpeg.parse(data[:at] + b"\xff\xfa\xe8\xc0junk" * 3 + data[at:])
    assert s.payload == payload and s.skipped == 24


def test_a_damaged_header_loses_one_frame_and_a_damaged_side_fails_its_checksum():
    data = bytearray(mpeg.write(mpeg.padded(b"x" * 20_000)))
    o = mpeg.parse(bytes(data)).offsets
    n = len(o)
    data[o[2] + 8] ^= 1
    assert mpeg.parse(bytes(data)).bad_checksums == 1
    data[o[5]] = 0
    s = mpeg.parse(bytes(data))
    assert s.frames == n - 1 and s.skipped == o[6] - o[5] and o[6] in s.offsets


@pytest.mark.parametrize("data", [b"", b"ID3", b"\xff", b"\xff\xfa\xe8\xc0", b"\0" * 100, b"ID3\x04\0\0\0\0\x7f\x7f"])
def test_broken_streams_give_no_frames(data):
    s = mpeg.parse(data)
    assert s.frames == 0 and s.payload == b"" and s.samples == 0


def naive(data):
    """Payload of a written stream, frame by frame by the format's formula for one channel at 32 kHz."""
    size = (data[6] << 21) + (data[7] << 14) + (data[8] << 7) + data[9]
    n = int(data[10 : 10 + size].rsplit(b"\0", 1)[1])
    at, out, frames = 10 + size, b"", 0
    while at < len(data):
        assert data[at : at + 2] == b"\xff\xfa" and data[at + 3] == 0xC0 and data[at + 2] & 15 == 8
        kbit = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][data[at + 2] >> 4]
        crc = 0xFFFF
        for bit in "".join(f"{b:08b}" for b in data[at + 2 : at + 4] + data[at + 6 : at + 23]):
            crc = ((crc << 1) ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)) & 0xFFFF
        assert crc == int.from_bytes(data[at + 4 : at + 6], "big")
        length = 1152 // 8 * kbit * 1000 // 32000
        out += data[at + 23 : at + length] if frames else b""
        at, frames = at + length, frames + 1
    return out[:n], frames - 1


@pytest.mark.parametrize("n", [0, 1, 1417, 50_000])
def test_written_streams_by_a_second_parser(n):
    payload = mpeg.padded(random.Random(n).randbytes(n))
    assert naive(mpeg.write(payload)) == (payload, mpeg.parse(mpeg.write(payload)).frames)


#: Version and layer bits, bit rate and sampling index, and by hand: bytes, samples and rate of a frame without padding.
KINDS = [
    (0xFB, 9, 0, 417, 1152, 44100), (0xFB, 9, 1, 384, 1152, 48000), (0xF3, 8, 0, 208, 576, 22050), (0xF3, 8, 2, 288, 576, 16000), (0xE3, 8, 0, 417, 576, 11025), (0xE3, 4, 2, 288, 576, 8000),
    (0xFD, 10, 0, 626, 1152, 44100), (0xF5, 8, 1, 384, 1152, 24000), (0xFF, 12, 0, 416, 384, 44100), (0xF7, 5, 1, 160, 384, 24000),
]


def frame(kind, mode=0xC0, fill=b"\x11"):
    word = bytes([0xFF, kind[0], kind[1] << 4 | kind[2] << 2, mode])
    return word + fill * (kind[3] - 4)


@pytest.mark.parametrize("kind", KINDS)
def test_versions_and_layers(kind):
    h = mpeg.header(frame(kind)[:4])
    assert (h.length, h.samples, h.hertz) == kind[3:]
    assert mpeg.header(bytes([0xFF, kind[0], kind[1] << 4 | kind[2] << 2 | 2, 0xC0])).length == kind[3] + (4 if kind[0] in (0xFF, 0xF7) else 1)
    s = mpeg.parse(b"junk" + frame(kind) * 10)
    assert (s.frames, s.samples, s.hertz, s.skipped) == (10, 10 * kind[4], kind[5], 4)


ID3V1 = b"TAG" + b"a title".ljust(30, b"\0") + b"someone".ljust(30, b" ") + b"\0" * 30 + b"1999" + b"\0" * 30 + b"\x05"


def ape(header):
    items = struct.pack("<II", 4, 0) + b"Album\0" + b"best"
    tail = lambda flags: b"APETAGEX" + struct.pack("<IIII", 2000, len(items) + 32, 1, flags) + b"\0" * 8
    return (tail(0xA0000000) if header else b"") + items + tail(0x80000000 if header else 0)


@pytest.mark.parametrize("tail", [b"", ID3V1, ape(False), ape(True), ape(True) + ID3V1])
def test_tags_behind_the_frames_are_no_audio(tail):
    s = mpeg.parse(frame(KINDS[0]) * 10 + tail)
    assert s.frames == 10 and s.skipped == 0
    assert s.tags == {**({"title": "a title", "artist": "someone", "year": "1999"} if ID3V1 in tail else {}), **({"Album": "best"} if b"APE" in tail else {})}


def test_tags_before_the_frames_in_every_version_and_encoding():
    said = "Grüße, 日本"
    for version, encoded in ((2, b"\x01" + said.encode("utf-16")), (3, b"\x01" + said.encode("utf-16")), (4, b"\x02" + said.encode("utf-16-be")), (4, b"\x03" + said.encode()), (3, b"\x00" + b"Gr\xfc\xdfe")):
        encoded += b" " * 200  # a size at which the kinds of numbers differ
        size = len(encoded)
        head = b"TT2" + size.to_bytes(3, "big") if version == 2 else b"TIT2" + (size.to_bytes(4, "big") if version == 3 else mpeg._synchsafe(size)) + b"\0\0"
        tag = head + encoded + b"\0" * 50
        s = mpeg.parse(b"ID3" + bytes([version, 0, 0]) + mpeg._synchsafe(len(tag)) + tag + frame(KINDS[0]) * 3)
        text = s.tags["TT2" if version == 2 else "TIT2"]
        assert s.frames == 3 and s.skipped == 0 and (text.startswith(said) or text.startswith("Grüße"))


@pytest.mark.parametrize("kind", [KINDS[0], KINDS[2]])
@pytest.mark.parametrize("name", [b"Xing", b"Info", b"VBRI"])
def test_tables_are_no_audio(kind, name):
    side = {0xFB: 17, 0xF3: 9}[kind[0]]
    whole = frame(kind) * 10
    if name == b"VBRI":
        told = b"\0" * 32 + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, len(whole) + kind[3], 10, 5, 2, 2, 2) + struct.pack(">5H", *[kind[3]] * 5)
    else:
        told = b"\0" * side + name + struct.pack(">III", 3, 10, len(whole))
    first = frame(kind)[:4] + told.ljust(kind[3] - 4, b"\0")
    s = mpeg.parse(first + whole + ID3V1)
    assert (s.frames, s.told_frames, s.samples) == (10, 10, 10 * kind[4]) and s.told_bytes in (len(whole), len(whole) + kind[3])
    assert s.spans == ([2 * kind[3]] * 5 if name == b"VBRI" else [])


def test_checksums_of_layer_one():
    for mode, covered in ((0xC0, 16), (0x00, 32), (0x40, 18), (0x70, 24)):
        word = bytes([0xFF, 0xFE, 12 << 4, mode])
        body = bytes(range(100, 100 + 64)) + b"\x11" * (416 - 4 - 2 - 64)
        whole = word + struct.pack(">H", mpeg.checksum(word[2:] + body[:covered])) + body
        assert mpeg.parse(whole * 4).bad_checksums == 0 and mpeg.parse(whole * 4).frames == 4
        assert mpeg.parse((whole[:10] + b"\0" + whole[11:]) * 4).bad_checksums == 4


def test_very_long_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x" * 3_000_000), (1, None)], "doc_id long, text string")
    rows = mpeg.read(mpeg.store(docs)).collect()
    assert sorted((len(r["payload"]), r["hertz"]) for r in rows) == [(64, 32000), (3_000_000, 32000)]
    assert mpeg.read(mpeg.store(docs.limit(0))).count() == 0


def test_query(spark, tmp_path):
    texts = [None, "", "a", "é" * 32, "same", "same", "long " * 40_000]
    spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, media binary").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op9_mpeg_audio(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(mpeg.write(payload)).hexdigest() and r["media_bytes"] == len(mpeg.write(payload))
    assert got[4]["feature"] == got[5]["feature"]
