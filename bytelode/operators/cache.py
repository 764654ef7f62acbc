"""Cached search results as rows: a put is a row (seq, pattern, positions), the last one of a pattern holds.

Look-ups join on the pattern's FNV hash and on the pattern itself, so a collision never gives another
pattern's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import as_bytes, fnv1a64


def entries(puts: DataFrame) -> DataFrame:
    """(hash, pattern, positions, count), one row for each pattern: its last put."""
    keyed = puts.select("seq", as_bytes(F.col("pattern")).alias("pattern"), "positions")
    last = keyed.groupBy("pattern").agg(F.max_by("positions", "seq").alias("positions"))
    return last.select(fnv1a64(F.col("pattern")).alias("hash"), "pattern", "positions", F.size("positions").cast("long").alias("count"))


def get(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of `asked` with (positions, count), null on a miss."""
    keyed = asked.withColumn("_hash", fnv1a64(F.col("pattern")))
    found = cache.select(F.col("hash").alias("_hash"), F.col("pattern").alias("_pattern"), "positions", "count")
    return keyed.join(found, (keyed["_hash"] == found["_hash"]) & (as_bytes(keyed["pattern"]) == F.col("_pattern")), "left").drop("_hash", "_pattern")


def hit_rate(log: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """Hits over look-ups, where each miss is put and nothing is evicted; 0 for an empty log."""
    n, new = F.count(pattern_col), F.countDistinct(pattern_col)
    return log.agg(n.alias("lookups"), new.alias("entries"), F.when(n == 0, 0.0).otherwise(1.0 - new / F.greatest(n, F.lit(1))).alias("hit_rate"))
