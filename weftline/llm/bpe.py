"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is split by a pattern; each piece is encoded by itself. The encodings of byte strings form a
monoid under ``join``: a piece is halved down to leaves, leaves are merged by rank, and neighbours are
joined by encoding anew a window around the seam that grows until its outer tokens stay.

Why the window is enough: in byte-pair encoding with ranks, a token sequence is the encoding of its
bytes exactly if each two neighbours are the encoding of their joint bytes (a merge that crosses no
seam can't be preceded by one that does if no pair of neighbours has one). Both sides of a seam are
encodings already, and so is the window; only its two outer seams are new, and ``join`` grows the
window until the two pairs there encode to themselves. With the window grown to both sides the join is
a plain encoding, so it ends. As in the library whose ids are matched, a piece that is a token as a
whole is that token, whatever the merges give.

Decoding is the same reduction with concatenation of bytes as the join, level by level from single tokens.

Defined results: a null or empty text has no tokens; text of any length is encoded whole; a lone
surrogate can't occur in a Spark string; equal rows give equal rows, and rows are encoded one by one, so ties change
nothing; an empty table gives no rows; columns that are not carried are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_slices, utf8

#: Bytes of a leaf of the tree, which one look-up encodes; tokens on each side of a seam in the first window that
#: is not remembered (the window before has one on each side).
LEAF, SEAM = 2, 2
#: Bytes up to which subtrees are remembered, and how many of them; how many windows of two tokens.
TWIG, TWIGS, MET = 6, 1 << 15, 1 << 16
#: Bytes from which windows are merged with a heap; length up to which pieces are remembered,
#: and how many in each of two generations.
LONG, SHORT, REMEMBERED = 96, 32, 80_000


class Pieces(dict):
    """Encodings of the pieces met so far. Pieces repeat, so each is encoded once for as long as it is here or in
    the generation before, from which pieces that still occur come back."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.before = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.before.get(piece)
        if got is None:
            got = b"".join(map(self.bpe.packed.__getitem__, self.bpe.piece(utf8(piece))))
            if len(piece) > SHORT:
                return got
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[piece] = got
        return got


class Bpe:
    """The ranks of a vocabulary file (lines of base64 token and rank) and a split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = np.empty(max(self.ranks.values()) + 1, object)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pieces = regex.compile(pattern).findall
        self.packed = {token: struct.pack("<I", rank) for token, rank in self.ranks.items()}
        self.known = Pieces(self)
        self.met = lru_cache(MET)(self._met)
        self.twig = lru_cache(TWIGS)(self._branch)

    def merge(self, data: bytes) -> list[bytes]:
        """Merges the neighbours of least rank, leftmost first, until none can be merged."""
        if len(data) > LONG:
            return self._merge_long(data)
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def _merge_long(self, data: bytes) -> list[bytes]:
        """The same merges from a heap of (rank, start) over a linked list, for long windows."""
        end, before, rank = list(range(1, len(data) + 1)), list(range(-1, len(data) - 1)), self.ranks.get
        heap = [(r, i, i + 2) for i in range(len(data) - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j >= len(data) or j < 0 or end[j] != stop:  # one of the two has been merged meanwhile
                continue
            end[i], end[j] = stop, -1
            if stop < len(data):
                before[stop] = i
                if (r := rank(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := rank(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        parts, i = [], 0
        while i < len(data):
            parts.append(data[i : end[i]])
            i = end[i]
        return parts

    def _met(self, a: bytes, b: bytes) -> list[bytes] | None:
        """The encoding of two neighbours' joint bytes, None if they stay."""
        merged = self.merge(a + b)
        return None if len(merged) == 2 and merged[0] == a else merged

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right:
            return left + right
        met, a, b, width = self.met, len(left) - 1, 1, SEAM
        window = met(left[a], right[0])
        if window is None:
            return left + right
        while (a and met(left[a - 1], window[0])) or (b < len(right) and met(window[-1], right[b])):
            a, b = max(0, len(left) - width), min(len(right), width)
            window, width = self.merge(b"".join(left[a:] + right[:b])), width * 4
        return left[:a] + window + right[b:]

    def tree(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return [data] if data in self.ranks else [data[i : i + 1] for i in range(len(data))]
        return self.twig(data) if len(data) <= TWIG else self._branch(data)

    def _branch(self, data: bytes) -> list[bytes]:
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, data: bytes) -> list[bytes]:
        return [data] if data in self.ranks else self.tree(data)

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenates neighbours, level by level, until one is left."""
        level = self.tokens[ids]
        while len(level) > 1:
            even = len(level) // 2 * 2
            level = np.concatenate([level[0:even:2] + level[1:even:2], level[even:]])
        return level[0] if len(level) else b""


@lru_cache(4)
def _loaded(path: str, pattern: str) -> Bpe:
    """The vocabulary in this worker; workers stay, so it is read once for many tasks."""
    return Bpe(path, pattern)


def _place(path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _mapped(df: DataFrame, carried: list[str], source: str, path: str | None, pattern: str | None, step, made: dict[str, str]) -> DataFrame:
    """df's columns carried, and those of made, which step gives for a Bpe and a value of source."""
    kinds = dict(df.dtypes)

    def rows(got: dict[str, list]) -> dict[str, list]:
        at, default = _place(path)
        bpe = _loaded(at, pattern or default)
        new = [step(bpe, value) for value in got[source]]
        return {c: got[c] for c in carried} | {c: list(values) for c, values in zip(made, zip(*new))}

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carried] + [f"{c} {kind}" for c, kind in made.items()])
    return map_slices(df.select(*dict.fromkeys([*carried, source])), rows, schema)


def encode(docs: DataFrame, carried: list[str] | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The carried columns (doc_id unless said otherwise) and ids (binary, little-endian unsigned 32-bit) of
    every row. The vocabulary file is looked up on the executors: it belongs to an installed package, or path
    is one that all machines have."""
    return _mapped(docs, carried or ["doc_id"], "text", path, pattern, lambda bpe, text: (bpe.encode_bytes(text) if text else b"",), {"ids": "binary"})


def decode(encoded: DataFrame, carried: list[str] | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The carried columns, ids and decoded (binary UTF-8) of rows with ids."""
    return _mapped(encoded, carried or ["doc_id"], "ids", path, pattern, lambda bpe, ids: (ids, bpe.decode(np.frombuffer(ids, "<u4"))), {"ids": "binary", "decoded": "binary"})


def tokenise(docs: DataFrame, carried: list[str] | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encode, then decode, in one pass: the carried columns, ids and decoded."""

    def both(bpe: Bpe, text: str | None) -> tuple[bytes, bytes]:
        ids = bpe.encode_bytes(text) if text else b""
        return ids, bpe.decode(np.frombuffer(ids, "<u4"))

    return _mapped(docs, carried or ["doc_id"], "text", path, pattern, both, {"ids": "binary", "decoded": "binary"})
