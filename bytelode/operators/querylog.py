"""Metrics of a query log: rows of (ts_ms, pattern, result_count, latency_us)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .timeseries import SeriesStore

#: Values that one task sorts at most for an exact quantile, and how close to its rank (as a share) they are cut.
SELECT, NEAR = 500_000, 0.0005
SERIES = ("query_count", "result_count", "latency")


def total(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"))


def unique(log: DataFrame, pattern_col: str = "pattern", lg_k: int | None = 12) -> DataFrame:
    """Distinct patterns: from a HyperLogLog sketch, or exact with lg_k None."""
    value = F.countDistinct(pattern_col) if lg_k is None else F.hll_sketch_estimate(F.hll_sketch_agg(pattern_col, lg_k))
    return log.agg(F.coalesce(value, F.lit(0)).cast("double").alias("unique_patterns"))


def latency_buckets(log: DataFrame, latency_col: str = "latency_us", alpha: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """(by ..., bucket, n): a sketch with relative error alpha; sketches add up by bucket.

    Bucket k holds values in (g^(k-1), g^k] with g = (1+a)/(1-a). Values that aren't positive are in the
    null bucket and count as 0.
    """
    growth = math.log((1 + alpha) / (1 - alpha))
    v = F.col(latency_col)
    return log.where(v.isNotNull()).groupBy(*(by or []), F.when(v > 0, F.ceil(F.log(v) / growth)).alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(log: DataFrame, at: list[float], latency_col: str = "latency_us", alpha: float = 0.01) -> DataFrame:
    """(q, value) with relative error alpha; no rows for an empty log.

    There are as many buckets as the values' range has decades (about 115 each), never as many as rows.
    """
    from pyspark.sql import Window as W

    g = (1 + alpha) / (1 - alpha)
    order = W.orderBy(F.col("bucket").asc_nulls_first())
    summed = latency_buckets(log, latency_col, alpha).select("bucket", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(W.partitionBy()).alias("all"))
    asked = summed.select("*", F.explode(F.array(*map(F.lit, at))).alias("q")).where(F.col("upto") > F.col("q") * (F.col("all") - 1))
    first = asked.groupBy("q").agg(F.min_by("bucket", "upto").alias("bucket"))
    return first.select("q", F.coalesce(2 * F.pow(F.lit(g), "bucket") / (g + 1), F.lit(0.0)).alias("value"))


def exact_quantiles(log: DataFrame, at: list[float], latency_col: str = "latency_us") -> DataFrame:
    """One row of doubles: the least value that a share q of the values doesn't exceed; nulls for an empty log.

    Each pass over the log takes two values close around the rank from a sketch and counts exactly on
    which side of them the rank lies, until at most `SELECT` values are left. No task holds more.
    """
    values = log.select(F.col(latency_col).cast("double").alias("v")).where("v is not null")
    n = values.count()
    found = [_at_rank(values, max(math.ceil(q * n), 1), n) if n else None for q in at]
    names = [T.StructField(f"p{100 * q:g}", T.DoubleType()) for q in at]
    return log.sparkSession.createDataFrame([tuple(found)], T.StructType(names))


def _at_rank(values: DataFrame, rank: int, n: int) -> float:
    """The value at a rank from 1 to n."""
    v = F.col("v")
    while n > SELECT:
        near = [min(1.0, max(0.0, rank / n + d)) for d in (-NEAR, NEAR)]
        low, high = values.agg(F.percentile_approx("v", near, 10_000)).first()[0]
        sides = [v < low, v == low, (v > low) & (v < high), (v == high) & (v > low), v > high]
        counts = values.agg(*(F.count_if(side) for side in sides)).first()
        for k, n in enumerate(counts):
            if rank <= n:
                break
            rank -= n
        if k in (1, 3):
            return low if k == 1 else high
        values = values.where(sides[k])
    return values.agg(F.sort_array(F.collect_list("v"))[rank - 1]).first()[0]


def frequency(log: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """(pattern, n), exact."""
    return log.groupBy(pattern_col).agg(F.count("*").alias("n"))


def count_min(log: DataFrame, pattern_col: str = "pattern", depth: int = 5, width: int = 2048) -> DataFrame:
    """(row, cell, n): a count-min sketch; sketches add up by cell."""
    cells = F.posexplode(F.array(*(_cell(F.col(pattern_col), d, width) for d in range(depth)))).alias("row", "cell")
    return log.select(cells).groupBy("row", "cell").agg(F.count("*").alias("n"))


def _cell(pattern: Column, row: int, width: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), pattern), F.lit(width))


def estimated_frequency(sketch: DataFrame, asked: DataFrame, pattern_col: str = "pattern", depth: int = 5, width: int = 2048) -> DataFrame:
    """(pattern, n) of the patterns asked for: never too few, 0 for an empty sketch."""
    cells = asked.select(pattern_col).distinct().select(pattern_col, F.posexplode(F.array(*(_cell(F.col(pattern_col), d, width) for d in range(depth)))).alias("row", "cell"))
    return cells.join(sketch, ["row", "cell"], "left").groupBy(pattern_col).agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))


def metric_points(log: DataFrame) -> DataFrame:
    """(series, ts_ms, value FLOAT): 1, the result count and the latency of each query."""
    points = [F.struct(F.lit(s).alias("series"), v.cast("float").alias("value")) for s, v in zip(SERIES, (F.lit(1.0), F.col("result_count"), F.col("latency_us")))]
    return log.select("ts_ms", F.explode(F.array(*points)).alias("p")).select("p.series", "ts_ms", "p.value")


class MetricsStore(SeriesStore):
    """The points of a query log; a write is durable when it returns, so there is nothing to flush."""

    def record(self, log: DataFrame) -> None:
        super().record(metric_points(log))

    def scan(self, series: str, start_ms: int, end_ms: int, version: int | None = None) -> DataFrame:
        """(ts_ms, value) with both ends included, in time order; opens the files of that series and time."""
        if series not in SERIES:
            raise ValueError(f"series is one of {SERIES}")
        return super().scan(series, start_ms, end_ms, version)

    def latency(self, start_ms: int, end_ms: int) -> DataFrame:
        return self.scan("latency", start_ms, end_ms)

    def results(self, start_ms: int, end_ms: int) -> DataFrame:
        return self.scan("result_count", start_ms, end_ms)

    def counts(self, start_ms: int, end_ms: int) -> DataFrame:
        return self.scan("query_count", start_ms, end_ms)
