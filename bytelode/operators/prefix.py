"""Running sums over a whole table, or over long groups of it, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import default_partitions


def sum_before(rows: DataFrame, by: list[str], order: list[str], values: dict[str, str], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds for each (name, column) of `values` the column's sum over the rows of the same `by` that come
    earlier by `order`, which must tell the rows of a group apart.

    Rows are range-partitioned and saved; a partition's rows are summed in order, and what comes before
    it follows from one row for each partition (and group in it). Nulls are groups and places, the first.
    """
    dealt = save(rows.repartitionByRange(default_partitions(rows.sparkSession), *by, *order).withColumn("_part", F.spark_partition_id()))
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = dealt.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in values.items()))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    renamed = [F.col(c).alias(f"_by_{k}") for k, c in enumerate(by)]
    offsets = totals.select(*renamed, F.col("_part").alias("_of"), *(zero(F.sum(f"_sum_{n}").over(earlier)).alias(f"_offset_{n}") for n in values))
    same = F.col("_part") == F.col("_of")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{k}"))
    inside = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = dealt.select("*", *(zero(F.sum(c).over(inside)).alias(n) for n, c in values.items()))
    # Without groups the offsets are as many as partitions.
    out = summed.join(offsets if by else F.broadcast(offsets), same)
    return out.select(*rows.columns, *((F.col(n) + F.col(f"_offset_{n}")).alias(n) for n in values))
