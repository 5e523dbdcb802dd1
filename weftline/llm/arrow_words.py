"""Words straight from Arrow buffers: bytes are classified with a look-up table, words begin and end where the class changes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text looked at in one go; a longer text is looked at by itself.
AT_ONCE = 1 << 21


@dataclass
class Words:
    """Words of rows first to last of a batch: bytes, starts and ends in them, and the row of each word, from 0."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray


def edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, which end where a row (offsets) ends."""
    padded = np.zeros(len(inside) + 2, np.int8)
    padded[1:-1] = inside
    turns = np.diff(padded)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    border = np.unique(offsets[1:-1])
    border = border[(border > 0) & (border < len(inside))]
    border = border[inside[border] & inside[border - 1]]
    if len(border):
        starts, ends = np.sort(np.concatenate([starts, border])), np.sort(np.concatenate([ends, border]))
    return starts, ends


def sliced(column: pa.Array, word_bytes: np.ndarray, at_once: int = AT_ONCE) -> Iterator[Words]:
    """The words of a string column, null as empty, in slices of whole rows of about at_once bytes."""
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + at_once, "right")) - 1)
        to = min(to, n)
        data, own = whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        starts, ends = edges(word_bytes[data], own)
        yield Words(at, to - at, data, own, starts, ends, np.searchsorted(own, starts, "right") - 1)
        at = to
