"""Chat formatting with a grammar round trip.

A turn is written as ``<turn LEVEL ROLE>TEXT</turn>`` and a newline. At level 0 the text stands as it is; it is read
back by the parser, and only where that does not give the same turn is the text escaped (level 1): a backslash
before each backslash, and one after the ``<`` of each control string. Level 1 leaves no control string in
the text and is undone by dropping the escaping backslashes, so the second round always agrees. Roles are
always percent-escaped.

Formatting needs no grouping, as each turn is a segment of its own; the text of a conversation is its
segments in order. Reading back runs over segments sorted by conversation and keeps one turn and running
digests in memory, so a conversation of any length passes through.

Defined results: a null text is empty, a null role is the empty role; a null conv_id is a conversation of its
own; turns that tie are ordered by role and text (nulls first), and repeated rows count each; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: Fixed values of the template: control strings, the header and the end of a turn, roles that are learnt.
CONTROL = ("</turn", "<turn")
HEADER = re.compile(r"<turn ([01]) ([^>\s]*)>")
END = "</turn>\n"
LEARNT = "assistant"

_ROLE_CHARS = re.compile(r"[%>\s]")
_ROLE_CODE = re.compile(r"%([0-9a-f]+);")
_ESCAPE = re.compile(r"\\|<(?=/?turn)")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else "<\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Reader:
    """Deterministic parser of formatted text that comes in parts: (role, text, loss text or None) of each turn
    as soon as it is complete. Raises ValueError at the first character that no turn can have there."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, part: str) -> Iterator[tuple[str, str]]:
        self.rest += part
        at = 0
        while at < len(self.rest):
            head = HEADER.match(self.rest, at)
            if head is None:
                if self.rest.find(">", at) >= 0:
                    raise ValueError("no turn starts here")
                break
            end = self.rest.find(END, head.end())
            if end < 0:
                break
            body = self.rest[head.end() : end]
            yield _ROLE_CODE.sub(lambda m: chr(int(m[1], 16)), head[2]), unescape(body) if head[1] == "1" else body
            at = end + len(END)
        self.rest = self.rest[at:]


def render(role: str, text: str) -> tuple[str, int, int]:
    """The segment of a turn and where its text is in it; escaped only if the plain one is read back otherwise."""
    name = _ROLE_CHARS.sub(lambda m: f"%{ord(m[0]):x};", role)
    for level, body in ((0, text), (1, escape(text))):
        head = f"<turn {level} {name}>"
        segment = head + body + END
        reader = Reader()
        try:
            if list(reader.feed(segment)) == [(role, text)] and not reader.rest and not (level == 0 and any(c in text for c in CONTROL)):
                return segment, len(head), len(head) + len(body)
        except ValueError:
            pass
    raise ValueError(f"a turn that can't be written: {role!r}")


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as they are, segment, and the loss mask in it (loss_start, loss_end in code
    points, null where nothing is learnt). No shuffle."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        made = [render(r or "", t or "") for r, t in zip(got["role"], got["text"])]
        loss = [r == LEARNT for r in got["role"]]
        return got | {
            "segment": [s for s, _, _ in made],
            "loss_start": [a if own else None for (_, a, _), own in zip(made, loss)],
            "loss_end": [b if own else None for (_, _, b), own in zip(made, loss)],
        }

    return map_slices(turns.select("conv_id", "turn", "role", "text"), rows, "conv_id long, turn long, role string, text string, segment string, loss_start int, loss_end int")


class _Conversation:
    def __init__(self) -> None:
        self.reader, self.turns, self.chars, self.loss_chars = Reader(), 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        self.chars += len(segment)
        for role, text in self.reader.feed(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if start is not None:
            masked = segment[start:end]
            if segment.startswith("<turn 1 "):
                masked = unescape(masked)
            self.loss_chars += len(masked)
            self.loss.update(masked.encode("utf-8", "surrogatepass"))

    def row(self, conv_id: int | None) -> tuple:
        if self.reader.rest:
            raise ValueError(f"conversation {conv_id} ends inside a turn")
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row of DIGESTS for each conversation, all of it parsed from the segments."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(DIGESTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: _Conversation | None = None
        conv_id: int | None = None
        for batch in batches:
            done = []
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512).to_pydict()
                for key, segment, start, end in zip(part["conv_id"], part["segment"], part["loss_start"], part["loss_end"]):
                    if conv is None or key != conv_id:
                        if conv is not None:
                            done.append(conv.row(conv_id))
                        conv, conv_id = _Conversation(), key
                    conv.add(segment, start, end)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done) if done else [[]] * len(schema), schema)], schema=schema)
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(conv.row(conv_id), schema)], schema=schema)

    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = formatted.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_order.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, DIGESTS)


def conversation_text(formatted: DataFrame) -> DataFrame:
    """conv_id and the whole formatted text of each conversation, for conversations that fit one row."""
    turn = F.struct("turn", "role", "text", "segment")
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["segment"]), "").alias("formatted"))
