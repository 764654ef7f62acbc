"""The query set: patterns as bytes, once each, and what they ask of a suffix index."""

from __future__ import annotations

import string
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns that go to the tasks as a stated set; a larger set becomes a table.
MOST_PATTERNS = 100_000
#: Up to so many patterns are counted by Spark expressions, more by one pass over each text for all.
FEW = 8
KEY_BYTES = 8
#: A-Z to a-z, as a table of bytes.
FOLD = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())

Patterns = DataFrame | Mapping | Iterable


def pattern_list(patterns: Patterns, ci: bool = False) -> list[tuple]:
    """(id, bytes) pairs. A mapping or a DataFrame of (id, pattern) gives the ids, else they count from 0.

    STRINGs stand for their UTF-8 bytes, and null patterns are left out. With `ci` A-Z are lowered. A
    query set is stated, so it is held by the driver whole; scans and a stored index take a table without that.
    """
    if isinstance(patterns, DataFrame):
        rows = patterns.select(F.col(patterns.columns[0]), F.col(patterns.columns[1]).cast("binary")).collect()
        found = [(r[0], r[1]) for r in rows]
    elif isinstance(patterns, Mapping):
        found = list(patterns.items())
    else:
        found = list(enumerate(patterns))
    out = [(i, p.encode() if isinstance(p, str) else bytes(p)) for i, p in found if p is not None]
    return [(i, p.translate(FOLD)) for i, p in out] if ci else out


def pattern_table(spark: SparkSession, patterns: Patterns, ci: bool = False) -> DataFrame:
    """(pattern_id, pattern BINARY); a DataFrame stays a table, with its ids as they are."""
    if isinstance(patterns, DataFrame):
        text = F.col(patterns.columns[1]).cast("binary")
        if ci:
            text = F.encode(F.translate(F.decode(text, "ISO-8859-1"), string.ascii_uppercase, string.ascii_lowercase), "ISO-8859-1")
        return patterns.select(F.col(patterns.columns[0]).alias("pattern_id"), text.alias("pattern")).where("pattern is not null")
    wanted = pattern_list(patterns, ci)
    kind = "string" if wanted and all(isinstance(i, str) for i, _ in wanted) else "long"
    return spark.createDataFrame([(i, bytearray(p)) for i, p in wanted], f"pattern_id {kind}, pattern binary")


def successor(prefix: bytes) -> bytes | None:
    """The least bytes above all that start with `prefix`; None where there are none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def key_range(key: Column, pattern: bytes, least: bytes | None = None) -> Column:
    """The index keys under which suffixes that start with `pattern` are, or from `least` on; pushed down to Parquet."""
    prefix = pattern[:KEY_BYTES]
    after = successor(prefix)
    low = key >= F.lit(prefix if least is None else least)
    return low if after is None else low & (key < F.lit(after))
