"""Where the matches of a pattern are in a text, in DataFrame functions only and in time linear in the text.

A fold that appends to an array copies it at each step, and a substring of a long text counts its characters from
the start. So folds go by blocks of ``BLOCK`` elements, what stands around a match is taken from the texts between the
matches, and pieces of a text are cut from chunks of ``CHUNK`` characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, CHUNK, AROUND = 256, 2048, 40


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; named by a lambda, since an expression is computed wherever it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, start: Column, kind: str, emit: Callable[[Column, Column], Column], step: Callable[[Column, Column], Column]) -> Column:
    """For each of the items, emit(state before it, item), an array of the type kind; the state goes from start by
    step(state, item)."""
    one, many = f"array<{kind}>", f"array<array<{kind}>>"

    def block(state: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(state.alias("s"), F.array().cast(one).alias("out")), lambda a, x: F.struct(step(a["s"], x).alias("s"), F.array_append(a["out"], emit(a["s"], x)).alias("out")))

    def fold(all_items: Column) -> Column:
        def merge(a: Column, at: Column) -> Column:
            return let(block(a["s"], F.slice(all_items, at * BLOCK + 1, BLOCK)), lambda r: F.struct(r["s"].alias("s"), F.array_append(a["out"], r["out"]).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_items) - 1, F.lit(0)) / BLOCK).cast("int"))
        return F.aggregate(blocks, F.struct(start.alias("s"), F.array().cast(many).alias("out")), merge, lambda a: F.flatten(a["out"]))

    return let(items, fold)


PLACE = "struct<start:int,end:int,s:string,before:string,after:string>"
PLACES = f"array<{PLACE}>"


def placed(matches: Column, gaps: Column, around: int = AROUND) -> Column:
    """PLACES of the matches, from them and the texts between them (one more than matches): offsets in code points, end
    exclusive, and at most ``around`` characters on either side, other matches included."""
    some = F.lit(around)
    left, right = lambda *x: F.left(F.concat(*x), some), lambda *x: F.right(F.concat(*x), some)
    behind = F.reverse(F.zip_with(matches, F.slice(gaps, 2, F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))))
    after = F.reverse(running(behind, F.lit(""), "string", lambda s, x: left(left(x["g"]), s), lambda s, x: left(left(x["m"]), left(x["g"]), s)))
    items = F.zip_with(F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))), after, lambda x, a: F.struct(x["m"].alias("m"), x["g"].alias("g"), a.alias("after")))

    def emit(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["g"])
        return F.struct(at.alias("start"), (at + F.length(x["m"])).alias("end"), x["m"].alias("s"), right(s["tail"], right(x["g"])).alias("before"), x["after"].alias("after"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"), right(s["tail"], right(x["g"]), right(x["m"])).alias("tail"))

    return running(items, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), PLACE, emit, step)


def found(text: Column, pattern: str, wanted: Column) -> tuple[Column, Callable[[Column], Column]]:
    """The matches of a pattern where wanted holds, and a function that gives the texts between them for the column of the
    matches. The two belong in projections of their own, so that neither is repeated."""
    none = F.array().cast("array<string>")
    matches = F.when(wanted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    return matches, lambda m: F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none)


def places_of(matches: Column, gaps: Column, around: int = AROUND) -> Column:
    return F.when(F.size(matches) > 0, placed(matches, gaps, around)).otherwise(F.array().cast(PLACES))


def apart(more: Column, sure: Column) -> Column:
    """Those of more (structs with start and end) that overlap none of sure. All are sorted by start once; the sure spans
    that start before one must have ended at its start, and the next to start must start at its end or later."""
    slim = lambda of, mine: F.transform(of, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(mine).alias("sure"), c.alias("c")))
    # At one start the sure come last: for a span that starts there, they start at it or later.
    both = F.array_sort(F.concat(slim(more, 0), slim(sure, 1)), lambda a, b: F.signum(F.when(a["start"] == b["start"], a["sure"] - b["sure"]).otherwise(a["start"] - b["start"])).cast("int"))

    def judged(all_spans: Column) -> Column:
        ended = running(all_spans, F.lit(0), "int", lambda s, x: s, lambda s, x: F.when(x["sure"] == 1, F.greatest(s, x["end"])).otherwise(s))
        begins = F.reverse(running(F.reverse(all_spans), F.lit((1 << 31) - 1), "int", lambda s, x: s, lambda s, x: F.when(x["sure"] == 1, x["start"]).otherwise(s)))
        known = F.zip_with(F.zip_with(all_spans, ended, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), begins, lambda x, n: F.struct(x["x"].alias("x"), x["e"].alias("e"), n.alias("n")))
        free = F.filter(known, lambda k: (k["x"]["sure"] == 0) & (k["e"] <= k["x"]["start"]) & (k["n"] >= k["x"]["end"]))
        return F.transform(free, lambda k: k["x"]["c"])

    return let(both, judged)


def between(chunks: Column, start: Column, end: Column) -> Column:
    """Characters from start up to end of the text whose chunks of CHUNK characters are given."""
    a, b = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    piece = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    one = F.substring(piece(a), start - a * CHUNK + 1, end - start)
    many = F.concat(F.substring(piece(a), start - a * CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(piece(b), F.lit(1), end - b * CHUNK))
    return F.when(end <= start, F.lit("")).when(a == b, one).otherwise(many)


def chunked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def replaced(text: Column, chunks: Column, spans: Column) -> Column:
    """The text with every span (structs with start, end and kind, sorted by start) replaced by its kind in brackets;
    overlapping spans are replaced together, under the kind of the first."""
    done = running(spans, F.lit(0), "string", lambda s, x: F.when(x["start"] < s, F.lit("")).otherwise(F.concat(between(chunks, s, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))), lambda s, x: F.greatest(s, x["end"]))
    return F.concat(F.array_join(done, ""), between(chunks, F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text)))
