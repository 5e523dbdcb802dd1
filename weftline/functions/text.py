"""Text functions as Column expressions; Arrow functions only for what Spark has no expression for."""

from __future__ import annotations

from collections.abc import Sequence
from unicodedata import normalize

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: White space as Python's str.strip and str.split see it, in Java's syntax.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Code point ranges of pictographs, selectors and joiners that are not spoken.
PICTURES = ((0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2B50, 0x2B50), (0x2B55, 0x2B55), (0x231A, 0x231B), (0x23E9, 0x23FA), (0xFE0F, 0xFE0F), (0x200D, 0x200D))
#: The same as a character class in Java's syntax (and RE2's).
EMOJI = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in PICTURES) + "]"
TAG_LABELS = ("happy", "angry", "sad", "relaxed", "surprised", "neutral")
TAG = r"^<e:(happy|angry|sad|relaxed|surprised|neutral):([0-9])>"
TAG_SHAPED = r"(?i)<\s*e\s*:[^>]*>"


#: The same characters one by one, for trimming.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trims all white space, not only blanks; unlike a pattern, it looks at the ends alone."""
    return F.btrim(text, F.lit(SPACES))


def clean(text: Column) -> Column:
    """Without pictographs, trimmed; null: empty. Texts of ASCII alone have none to look for."""
    plain = F.coalesce(text, F.lit(""))
    return strip(F.when(F.octet_length(plain) == F.length(plain), plain).otherwise(F.regexp_replace(plain, EMOJI, "")))


def spoken(text: Column) -> Column:
    """clean, without bold marks, white space collapsed."""
    return strip(F.regexp_replace(F.replace(clean(text), F.lit("**"), F.lit("")), rf"{SPACE}+", " "))


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, for which Spark has no expression."""
    return text.map(lambda t: normalize("NFC", t), na_action="ignore")


def spoken_words(text: Column, composed: bool = False) -> Column:
    """Lower-case words of letters, marks, digits and apostrophes, for scoring, of the text in NFC. composed: it is
    in NFC already, so that the expression stays in the JVM."""
    kept = F.regexp_replace(F.lower(text if composed else nfc(text)), r"\p{Cf}", "")
    return tokens(F.regexp_replace(kept, r"[^\p{L}\p{M}\p{N}']", " "))


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Least number of insertions, deletions and replacements between two sequences of any length: a column of the
    table of distances is held as the bits of two integers, one step for each item of the shorter one."""
    at, end = 0, min(len(a), len(b))
    while at < end and a[at] == b[at]:
        at += 1
    back = 0
    while back < end - at and a[-1 - back] == b[-1 - back]:
        back += 1
    a, b = sorted((a[at : len(a) - back], b[at : len(b) - back]), key=len)
    if not a:
        return len(b)
    where: dict = {}
    for i, x in enumerate(b):
        where.setdefault(x, []).append(i)
    bits = {}
    for x in set(a) & where.keys():
        row = bytearray(len(b) // 8 + 1)
        for i in where[x]:
            row[i >> 3] |= 1 << (i & 7)
        bits[x] = int.from_bytes(row, "little")
    whole, last = (1 << len(b)) - 1, 1 << (len(b) - 1)
    up, down, distance = whole, 0, len(b)
    for x in a:
        equal = bits.get(x, 0)
        level = (((equal & up) + up) ^ up) | equal
        more, less = down | (whole & ~(level | up)), up & level
        distance += bool(more & last) - bool(less & last)
        more, less, equal = (more << 1 | 1) & whole, (less << 1) & whole, equal | down
        up, down = less | (whole & ~(equal | more)), more & equal
    return distance


@F.arrow_udf(IntegerType())
def word_errors(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Word-level edit distance of two arrays of words, of any length; null only against a null array. Spark's own
    distance of strings takes the product of both lengths, and has symbols for some 137,000 distinct words only."""
    # One pair at a time becomes Python objects.
    pairs = ((r.as_py(), h.as_py()) for r, h in zip(reference, hypothesis))
    return pa.array([None if r is None or h is None else edit_distance(r, h) for r, h in pairs], pa.int32())


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Rate of one utterance: an empty reference gives 0 against nothing, else 1."""
    empty = F.when(F.size(hypothesis) == 0, 0.0).otherwise(1.0)
    return F.when(F.size(reference) == 0, empty).otherwise(word_errors(reference, hypothesis) / F.size(reference))


def hash_bucket(key: Column, buckets: int, digits: int = 8) -> Column:
    """A stable bucket from the first hex digits of the SHA-256 of key."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, digits), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def seeded_bucket(key: Column, seed: int = 0, buckets: int = 1000) -> Column:
    return hash_bucket(F.concat(F.lit(f"{seed}:"), key), buckets, 12)


def split_side(key: Column, seed: int = 0, fraction: float = 0.05, buckets: int = 1000) -> Column:
    """val or train by the bucket of the key; the threshold is cut to a whole number of buckets."""
    return F.when(seeded_bucket(key, seed, buckets) < int(fraction * buckets), "val").otherwise("train")


def digest12(*parts: Column | str) -> Column:
    """The first 12 hex digits of the SHA-256 of the parts, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def annotated(transcript: Column, annotation: Column) -> Column:
    """A user message with how it was said before it, where that is known."""
    return F.when(annotation.isNull(), transcript).otherwise(F.concat(F.lit("[voice: "), annotation, F.lit("] "), transcript))


def tag_verdict(reply: Column) -> Column:
    """struct(verdict, label, intensity) of a reply that should begin with one tag."""
    text = F.regexp_replace(reply, rf"^{SPACE}+", "")
    valid, shaped = text.rlike(TAG), F.regexp_count(text, F.lit(TAG_SHAPED))
    verdict = F.when(~valid, F.when(shaped > 0, "malformed").otherwise("missing")).when(shaped > 1, "misplaced").otherwise("ok")
    label = F.when(valid, F.regexp_extract(text, TAG, 1))
    return F.struct(verdict.alias("verdict"), label.alias("label"), F.when(valid, F.regexp_extract(text, TAG, 2).cast("int")).alias("intensity"))


def leading_tag(reply: Column) -> Column:
    """struct(label, intensity in 0..1, text): the tag at the start of a reply and what is spoken; without a tag,
    neutral at one half and all of the text."""
    pattern = "(?i)" + TAG
    found = reply.rlike(pattern)
    rest = F.regexp_replace(F.regexp_replace(reply, pattern, ""), rf"^{SPACE}+", "")
    return F.struct(
        F.when(found, F.lower(F.regexp_extract(reply, pattern, 1))).otherwise("neutral").alias("label"),
        F.when(found, F.regexp_extract(reply, pattern, 2).cast("double") / 9).otherwise(0.5).alias("intensity"),
        F.when(found, rest).otherwise(reply).alias("text"),
    )


def html_text(html: Column) -> Column:
    return strip(F.regexp_replace(html, "<[^>]+>", ""))


def html_links(html: Column, most: int = 5) -> Column:
    """The first targets of links."""
    return F.slice(F.regexp_extract_all(html, F.lit(r'(?s)<a href="([^"]*)"'), F.lit(1)), 1, most)


def annotator_tag(text: Column) -> Column:
    return text.rlike("<[^<>]{0,40}>")


def first_text(columns: Sequence[Column]) -> Column:
    """The first of the columns that is not blank, trimmed; else empty."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns], F.lit(""))


def blocked(text: Column, phrases: Sequence[str]) -> Column:
    return F.lower(F.regexp_replace(text, r"^[.,!? ]+|[.,!? ]+$", "")).isin(*phrases)


def url_name(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)
