"""Media columns: MPEG audio streams, written, resynchronised, verified and indexed.

A stream is an ID3v2 tag, a frame with a Xing table (frames, bytes, table of seek points) and MPEG-1 layer III
frames, one channel at 32 kHz, where every frame length is a whole number and needs no padding. Frames have
the checksum that the format provides, over the second half of the header and the side information. Bytes
to be kept are the main data of the frames, which is the format's own unit; the bit rate varies from frame
to frame, so that the last frame is the shortest that holds what is left.

The parser reads streams of any writer: versions 1, 2 and 2.5, layers I to III (free format apart), with tags before (ID3v2.2 to
2.4 in any text encoding) and behind (ID3v1, APE) the frames, which it takes off first, and with a Xing, Info or VBRI frame, which
is no audio. It takes what looks like a header only if its checksum holds or a header of the same version, layer and rate (or
the end) follows where it says, so that other bytes are not taken for one; it counts checksums that fail (those of layer
II, whose extent depends on its allocation tables, are not looked at) and goes on behind damage. It
returns exact durations (samples over rate, no rounding), the offset of each frame for seeking, the tags and
the table.

Defined results: a null text is stored like an empty one; a payload is padded with zero bytes to a positive
multiple of 64; equal texts give equal bytes; a text of any length is one stream, held by one task; rows are judged one by one, so
ties, repeats, empty tables and extra columns change nothing.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import map_slices, utf8

#: Fixed values of the format. Bit rates in kbit/s by version (1, or 2 and 2.5), layer and index; sampling rates by version and index.
BIT_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS, LAYERS = {3: 1.0, 2: 2.0, 0: 2.5}, {3: 1, 2: 2, 1: 3}
#: Samples of a frame by layer, layer III by version; side information bytes of layer III by version, for one channel and for two.
FRAME_SAMPLES, SIDES = {1: 384, 2: 1152, 3: {1.0: 1152, 2.0: 576, 2.5: 576}}, {1.0: (17, 32), 2.0: (9, 17), 2.5: (9, 17)}
#: What is written: version 1, layer III, one channel.
RATES, SAMPLES, SIDE = BIT_RATES[1, 3], 1152, {True: 17}
BLOCK = 64
POINTS = 100


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


def checksum(data: bytes) -> int:
    """CRC-16 of the format: polynomial 8005, start FFFF."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


@dataclass(frozen=True)
class Header:
    """kind: version, layer and sampling rate, the same in all frames of a stream. side: bytes of side information (layer III);
    covered: bytes behind the checksum that it covers, None if that is not told by the header."""

    length: int
    hertz: int
    protected: bool
    side: int
    samples: int
    kind: tuple
    covered: int | None


def header(word: bytes) -> Header | None:
    """A frame header from its four bytes, or None."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(word[1] >> 3 & 3), LAYERS.get(word[1] >> 1 & 3)
    rate, hertz, pad = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1
    if version is None or layer is None or not 0 < rate < 15 or hertz == 3 or word[3] & 3 == 2:
        return None
    hz, kbit, mode = SAMPLE_RATES[version][hertz], BIT_RATES[1 if version == 1.0 else 2, layer][rate], word[3] >> 6
    samples = FRAME_SAMPLES[layer] if layer < 3 else FRAME_SAMPLES[3][version]
    # A slot is a byte, four bytes in layer I; a frame holds the bits of its samples' time.
    slot = 4 if layer == 1 else 1
    length = (samples // 8 * 1000 // slot * kbit // hz + pad) * slot
    side = SIDES[version][mode != 3] if layer == 3 else 0
    # Layer I: four bits a subband and channel; joint stereo shares those from a bound on.
    bands = 32 if mode == 3 else 64 if mode != 1 else 32 + 4 * ((word[3] >> 4 & 3) + 1)
    covered = {1: bands // 2, 2: None, 3: side}[layer]
    return Header(length, hz, not word[1] & 1, side, samples, (version, layer, hz), covered)


def _head(rate: int) -> bytes:
    """Header and side information of a frame at 32 kHz, one channel, with the checksum between them."""
    word = bytes([0xFF, 0xFA, rate << 4 | 2 << 2, 0xC0])
    bits = min(4095, 8 * _room(rate))
    # main_data_begin 0, private and share bits 0, then part2_3_length of the first granule.
    side = (bits << (17 * 8 - 18 - 12)).to_bytes(17, "big")
    return word + struct.pack(">H", checksum(word[2:] + side)) + side


def _room(rate: int) -> int:
    return 144 * RATES[rate] // 32 - 4 - 2 - SIDE[True]


_HEADS = {rate: _head(rate) for rate in range(1, 15)}


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def write(payload: bytes) -> bytes:
    """The stream of a payload."""
    full = _room(14)
    whole, rest = divmod(len(payload), full)
    last = next((r for r in range(1, 15) if _room(r) >= rest), 14) if rest else 0
    frames = np.zeros((whole, full + len(_HEADS[14])), np.uint8)
    frames[:, : len(_HEADS[14])] = np.frombuffer(_HEADS[14], np.uint8)
    frames[:, len(_HEADS[14]) :] = np.frombuffer(payload, np.uint8, whole * full).reshape(whole, full)
    body = frames.tobytes()
    if rest:
        body += _HEADS[last] + payload[whole * full :] + b"\0" * (_room(last) - rest)
    count, total = whole + (last > 0), len(body)
    # Seek points: for each hundredth of the duration, the share of the bytes before it in 256ths.
    starts = np.minimum(np.arange(POINTS) * count // POINTS, max(0, count - 1)) * frames.shape[1]
    table = bytes((np.minimum(255, 256 * starts // max(1, total))).astype(np.uint8))
    xing = b"Xing" + struct.pack(">III", 7, count, total) + table
    first = _HEADS[9] + xing + b"\0" * (_room(9) - len(xing))
    note = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + _synchsafe(len(note)) + b"\0\0" + note
    return b"ID3\x04\0\0" + _synchsafe(len(tag)) + tag + first + body


@dataclass
class Stream:
    """What a parse found. offsets: of the audio frames; samples and hertz give the exact duration."""

    tags: dict[str, str] = field(default_factory=dict)
    frames: int = 0
    samples: int = 0
    hertz: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    told_frames: int | None = None
    told_bytes: int | None = None
    seek: bytes = b""
    #: Bytes from one seek point to the next, as a VBRI frame tells them.
    spans: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    body: bytes = b""

    @property
    def payload(self) -> bytes:
        n = self.tags.get("payload_bytes", "")
        return self.body[: int(n)] if n.isdigit() else self.body

    def feature(self) -> str:
        """Frames, duration as an exact fraction of seconds, bad checksums, skipped bytes, and the first, middle
        and last frame offsets."""
        o = self.offsets
        some = ",".join(str(o[i]) for i in (0, len(o) // 2, len(o) - 1)) if o else ""
        return f"frames={self.frames};seconds={self.samples}/{self.hertz or 1};bad={self.bad_checksums};skipped={self.skipped};offsets={some}"


ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _text(raw: bytes) -> str:
    """A text of a tag: its encoding, then what it says."""
    return raw[1:].decode(ENCODINGS[raw[0]], "replace") if raw and raw[0] < len(ENCODINGS) else ""


def _size(raw: bytes, bits: int) -> int:
    return sum((b & ((1 << bits) - 1)) << bits * (len(raw) - 1 - i) for i, b in enumerate(raw))


def _front(data: bytes, out: Stream) -> int:
    """Reads an ID3v2 tag at the start, if there is one; where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4):
        return 0
    version, flags, size = data[3], data[5], _size(data[6:10], 7)
    at, end, names = 10, min(len(data), 10 + size), 3 if version == 2 else 4
    if flags & 0x40 and version > 2:  # an extended header; its size counts itself in 2.4 only
        at += _size(data[10:14], 7) if version == 4 else 4 + _size(data[10:14], 8)
    head = 6 if version == 2 else 10
    while at + head <= end and data[at : at + names].strip(b"\0"):
        name, n = data[at : at + names].decode("latin-1"), _size(data[at + names : at + 2 * names], 7 if version == 4 else 8)
        if name[0] == "T":
            key, zero, value = _text(data[at + head : min(end, at + head + n)]).partition("\0")
            own = name in ("TXXX", "TXX") and zero
            out.tags[key if own else name] = value.lstrip("\ufeff").rstrip("\0") if own else key
        at += head + n
    return 10 + size + (10 if version == 4 and flags & 0x10 else 0)


def _back(data: bytes, out: Stream) -> int:
    """Reads ID3v1 and APE tags at the end, if there are any; where the audio ends."""
    end = len(data)
    if data[max(0, end - 128) : end - 125] == b"TAG" and end >= 128:
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            value = data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip()
            if value:
                out.tags.setdefault(name, value)
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        _, size, items, flags = struct.unpack("<IIII", data[end - 24 : end - 8])
        at, stop = max(0, end - size), end - 32
        for _ in range(items):
            zero = data.find(b"\0", at + 8, stop)
            if zero < 0:
                break
            n, kind = struct.unpack("<II", data[at : at + 8])
            if not kind & 6:  # a text
                out.tags.setdefault(data[at + 8 : zero].decode("latin-1"), data[zero + 1 : min(stop, zero + 1 + n)].decode("utf-8", "replace"))
            at = zero + 1 + n
        end = max(0, end - size - (32 if flags >> 31 else 0))
    return end


def _table(frame: bytes, h: Header, out: Stream) -> bool:
    """Reads a frame that tells of the others instead of being heard."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, place = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        if flags & 1:
            out.told_frames, place = int.from_bytes(frame[place : place + 4], "big"), place + 4
        if flags & 2:
            out.told_bytes, place = int.from_bytes(frame[place : place + 4], "big"), place + 4
        if flags & 4:
            out.seek = frame[place : place + POINTS]
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.told_bytes, out.told_frames, entries, scale, width, _ = struct.unpack(">IIHHHH", frame[46:62])
        table = frame[62 : 62 + entries * width]
        out.spans = [scale * int.from_bytes(table[i : i + width], "big") for i in range(0, len(table) - width + 1, width)] if width else []
        return True
    return False


def parse(data: bytes) -> Stream:
    """Reads a stream back, past any damage between frames."""
    out, known, checked, parts = Stream(), {}, {}, []
    at, end, first, kind = _front(data, out), _back(data, out), True, None

    def told(place: int) -> Header | None:
        word = data[place : min(end, place + 4)]
        if word not in known:
            known[word] = header(word)
        return known[word]

    while at + 4 <= end:
        h, good = told(at), False
        taken = h is not None and at + h.length <= end and kind in (None, h.kind)
        if taken:
            follows, begin = at + h.length, at + 4 + 2 * h.protected
            if h.protected and h.covered is not None:
                cover = data[at + 2 : at + 4] + data[begin : begin + h.covered]
                if cover not in checked:
                    checked[cover] = checksum(cover)
                good = checked[cover] == int.from_bytes(data[at + 4 : begin], "big")
            after = told(follows)
            # What looks like a header counts if its checksum holds, or another header or the end is where it says.
            taken = good or follows == end or (after is not None and after.kind == h.kind)
        if not taken:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        out.bad_checksums += h.protected and h.covered is not None and not good
        if not (first and h.kind[1] == 3 and _table(data[at:follows], h, out)):
            out.frames, out.samples, out.hertz = out.frames + 1, out.samples + h.samples, h.hertz
            out.offsets.append(at)
            parts.append(data[begin + h.side : follows])
        at, first, kind = follows, False, h.kind
    out.skipped += max(0, end - at)
    out.body = b"".join(parts)
    return out


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, the stream of its padded UTF-8 bytes."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        raw = [utf8(t) for t in got["text"]]
        return {"doc_id": got["doc_id"], "n_bytes": [len(r) for r in raw], "media": [write(padded(r)) for r in raw]}

    return map_slices(docs.select("doc_id", "text"), rows, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media as they are, and what its stream says: payload, samples and hertz (their ratio is the exact
    duration in seconds), frames, bad_checksums, offsets (array of long) and feature."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        found = [parse(m or b"") for m in got["media"]]
        return got | {
            "payload": [s.payload for s in found], "samples": [s.samples for s in found], "hertz": [s.hertz for s in found], "frames": [s.frames for s in found],
            "bad_checksums": [s.bad_checksums for s in found], "offsets": [s.offsets for s in found], "feature": [s.feature() for s in found],
        }

    return map_slices(media.select("doc_id", "n_bytes", "media"), rows, "doc_id long, n_bytes long, media binary, payload binary, samples long, hertz long, frames long, bad_checksums long, offsets array<long>, feature string")
