"""Byte semantics on Spark columns: one character stands for one byte, whatever the encoding."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_bytes(text: Column) -> Column:
    """A STRING's UTF-8 bytes; BINARY as it is."""
    return text.cast("binary")


def byte_text(text: Column) -> Column:
    """A string with one character for each byte, in the same order as the bytes."""
    return F.decode(as_bytes(text), "ISO-8859-1")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike lower(). For byte texts and strings."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def overlapping_regex(pattern: Column) -> Column:
    """A look-ahead for a quoted pattern: it matches at each place where the pattern starts."""
    return F.concat(F.lit(r"(?=\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E)"))


def occurrences(text: Column, pattern: Column) -> Column:
    """Overlapping occurrences, as BIGINT, of one byte text in another.

    An empty pattern occurs at each of the N + 1 places; one that holds the byte 0 never occurs.
    """
    n = F.regexp_count(text, overlapping_regex(pattern)).cast("long")
    return F.when(F.contains(pattern, F.lit("\0")), F.lit(0).cast("long")).otherwise(n)


def has_border(pattern: bytes) -> bool:
    """Whether the pattern can overlap itself: a proper prefix of it is a suffix, too."""
    return any(pattern.startswith(pattern[k:]) for k in range(1, len(pattern)))


def literal_occurrences(text: Column, pattern: bytes, encoding: str = "latin-1") -> Column:
    """`occurrences` of a known pattern, from the length that its removal takes off where it cannot overlap itself.

    With encoding "utf-8" the text is a STRING as it is and the pattern's bytes are UTF-8.
    """
    if b"\0" in pattern:
        return F.when(text.isNotNull(), F.lit(0).cast("long"))
    size = F.octet_length(as_bytes(text)) if encoding == "utf-8" else F.length(text)
    if not pattern:
        return (size + 1).cast("long")
    if has_border(pattern):
        return occurrences(text if encoding == "latin-1" else byte_text(text), F.lit(pattern.decode("latin-1")))
    known = pattern.decode(encoding)
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(known), F.lit("")))) / len(known.encode())).cast("long")


def holds(text: Column, pattern: Column) -> Column:
    """Whether a pattern occurs; like `occurrences` for empty patterns and the byte 0."""
    return F.contains(text, pattern) & ~F.contains(pattern, F.lit("\0"))


def fnv1a64(data: Column) -> Column:
    """FNV-1a with 64 bits of a STRING's or BINARY's bytes, as a signed BIGINT.

    The product by 0x100000001b3 is taken in two halves, so that nothing overflows.
    """
    low = F.lit(0xFFFFFFFF)
    codes = F.transform(F.filter(F.split(F.hex(as_bytes(data)), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("long"))

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        lo, hi = x.bitwiseAND(low), F.shiftrightunsigned(x, 32)
        q = lo * 435
        top = (hi * 435 + F.shiftrightunsigned(q, 32) + F.shiftleft(lo, 8)).bitwiseAND(low)
        return F.shiftleft(top, 32).bitwiseOR(q.bitwiseAND(low))

    offset = 0xCBF29CE484222325 - (1 << 64)
    return F.aggregate(codes, F.lit(offset).cast("long"), step)
