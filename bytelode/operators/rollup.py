"""Metrics of a query log that merge over time: sketches by minute, rolled up to spans of 2, 4, 8 ... minutes.

A row (level, start_ms, kind, key, n, sketch) holds what a span of 2^level minutes has seen: queries with a HyperLogLog sketch of
their patterns, latencies by bucket, and patterns by count-min cell. All of them add up, by sums and unions of sketches, so
parts may be written by batches and by streams, and a range of time is covered by at most two spans of each level:
no log row is read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import Files
from .querylog import _cell

MINUTE = 60_000
#: Spans of up to 2^LEVELS minutes (two thousand years), and the sketches' sizes.
LEVELS, LG_K, ALPHA, DEPTH, WIDTH = 30, 12, 0.01, 5, 2048
QUERIES, LATENCY, CELL = 0, 1, 2
#: The key of latencies that are not positive.
_NONE = -(1 << 40)
_ROWS = "level int, start_ms long, kind int, key long, n long, sketch binary, part string"


def points(log: DataFrame) -> DataFrame:
    """(ts_ms, kind, key, pattern): what each row of (ts_ms, pattern, latency_us) adds to; a latency may be null."""
    growth = F.log(F.lit((1 + ALPHA) / (1 - ALPHA)))
    bucket = F.when(F.col("latency_us") > 0, F.ceil(F.log(F.col("latency_us")) / growth).cast("long")).otherwise(_NONE)
    point = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("long").alias("key"))
    cells = [F.when(F.col("pattern").isNotNull(), point(CELL, row * WIDTH + _cell(F.col("pattern"), row, WIDTH))) for row in range(DEPTH)]
    each = F.array_compact(F.array(point(QUERIES, F.lit(0)), F.when(F.col("latency_us").isNotNull(), point(LATENCY, bucket)), *cells))
    return log.select("ts_ms", "pattern", F.explode(each).alias("p")).select("ts_ms", "p.kind", "p.key", F.when(F.col("p.kind") == QUERIES, F.col("pattern").cast("string")).alias("pattern"))


def _seen() -> list:
    return [F.count("*").alias("n"), F.hll_sketch_agg("pattern", LG_K).alias("sketch")]


def minutes(log: DataFrame) -> DataFrame:
    """(start_ms, kind, key, n, sketch) of a batch."""
    start = (F.col("ts_ms") - F.pmod("ts_ms", F.lit(MINUTE))).alias("start_ms")
    return points(log).groupBy(start, "kind", "key").agg(*_seen())


def minutes_stream(log: DataFrame, delay: str) -> DataFrame:
    """The same of a stream, each minute once it is `delay` before the latest row seen. Rows that come later than that
    are left out; those that come in time count wherever they stand in the stream."""
    timed = points(log).withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", "1 minute").alias("w"), "kind", "key").agg(*_seen()).select(F.unix_millis("w.start").alias("start_ms"), "kind", "key", "n", "sketch")


def rolled(base: DataFrame) -> DataFrame:
    """(level, start_ms, kind, key, n, sketch) of minutes: each adds to one span of each level."""
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    span = F.expr(f"start_ms - pmod(start_ms, shiftleft({MINUTE}L, level))")
    each = base.select(level, "start_ms", "kind", "key", "n", "sketch").withColumn("start_ms", span)
    merged = each.groupBy("level", "start_ms", "kind", "key").agg(F.sum("n").alias("n"), F.when(F.col("kind") == QUERIES, F.hll_union_agg("sketch")).alias("sketch"))
    return merged


def cover(start: int, end: int) -> list[tuple[int, int]]:
    """(level, start in minutes) of the spans, two of a level at most, that make up the minutes [start, end)."""
    out = []
    while start < end:
        level = min((start & -start).bit_length() - 1 if start else LEVELS, (end - start).bit_length() - 1, LEVELS)
        out.append((level, start))
        start += 1 << level
    return out


class MetricRollup:
    """A folder of parts; what they hold adds up."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, base: DataFrame, part: str) -> None:
        rolled(base).write.mode("overwrite").partitionBy("level").parquet(f"{self.path}/part={part}")

    def add(self, log: DataFrame) -> None:
        self._write(minutes(log), uuid.uuid4().hex)

    def add_stream(self, log: DataFrame, checkpoint: str, delay: str = "10 minutes") -> StreamingQuery:
        """Adds the minutes of a stream of (ts_ms, pattern, latency_us) that are closed, and ends; run it again for more.

        A batch that runs again after a failure replaces its part.
        """
        writer = minutes_stream(log, delay).writeStream.outputMode("append").foreachBatch(lambda df, epoch: self._write(df, f"stream-{epoch}"))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def rows(self, kind: int, start_ms: int, end_ms: int) -> DataFrame:
        """The rows of one kind that make up the minutes from that of start_ms to before that of end_ms."""
        spans: dict[int, list[int]] = {}
        for level, at in cover(start_ms // MINUTE, end_ms // MINUTE):
            spans.setdefault(level, []).append(at * MINUTE)
        wanted = F.lit(False)
        for level, at in spans.items():
            wanted = wanted | ((F.col("level") == level) & F.col("start_ms").isin(at))
        if not Files(self.spark, self.path).exists():
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(self.path).where((F.col("kind") == kind) & wanted)

    def summary(self, start_ms: int, end_ms: int) -> DataFrame:
        """One row (total, unique_patterns)."""
        sketch = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
        return self.rows(QUERIES, start_ms, end_ms).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(sketch, F.lit(0)).cast("double").alias("unique_patterns"))

    def quantiles(self, start_ms: int, end_ms: int, at: list[float]) -> DataFrame:
        """(q, value) with relative error ALPHA; there are as many buckets as the latencies' range has decades, times 115."""
        g = (1 + ALPHA) / (1 - ALPHA)
        held = self.rows(LATENCY, start_ms, end_ms).groupBy("key").agg(F.sum("n").alias("n"))
        summed = held.select("key", F.sum("n").over(W.orderBy("key").rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(W.partitionBy()).alias("all"))
        asked = summed.select("*", F.explode(F.array(*map(F.lit, at))).alias("q")).where(F.col("upto") > F.col("q") * (F.col("all") - 1))
        first = asked.groupBy("q").agg(F.min("key").alias("key"))
        return first.select("q", F.when(F.col("key") == _NONE, 0.0).otherwise(2 * F.pow(F.lit(g), "key") / (g + 1)).alias("value"))

    def frequency(self, start_ms: int, end_ms: int, asked: DataFrame) -> DataFrame:
        """(pattern, n) of the patterns asked for: never too few."""
        cells = asked.select("pattern").distinct().select("pattern", F.explode(F.array(*(row * WIDTH + _cell(F.col("pattern"), row, WIDTH) for row in range(DEPTH)))).alias("key"))
        held = self.rows(CELL, start_ms, end_ms).groupBy("key").agg(F.sum("n").alias("n"))
        return cells.join(held, "key", "left").groupBy("pattern").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
