"""Sharding by size: global byte prefix sums from per-partition totals, cut at equal targets.

DataFrame operations only. Texts never move: one pass takes (id, size, checksum), which alone
is range-partitioned by id and written; totals per partition give each partition's offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, default_partitions, table


def shard_by_size(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot): contiguous runs of the id order with near equal bytes.

    A row's size is its text's UTF-8 bytes (null: none) plus `overhead`. A row goes to the shard in
    which the middle of its bytes falls, so a shard misses its target by half of the rows at its two
    ends at most; a row larger than a target can leave a shard empty. Slots count from 0 in each shard.
    Rows are ordered by (id, text checksum, size), null first, so repeated ids have a defined place.
    Equal texts are not kept together: where a third of the rows share one, shards with near equal bytes
    could not hold it. Null text has a null checksum. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    order = ["id", "text_crc32", "size"]
    sized = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
    )
    spread = sized.repartitionByRange(default_partitions(spark), *order)
    slim = scratch.write(spread.withColumn("part", F.spark_partition_id()))
    # One row per partition: its count is set by the cluster, not by the rows.
    before, all_parts = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = (
        slim.groupBy("part").agg(F.sum("size").alias("bytes"))
        .select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_start"), F.sum("bytes").over(all_parts).alias("total"))
    )
    inside = W.partitionBy("part").orderBy(*order)
    start = F.col("part_start") + F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = (
        slim.join(F.broadcast(offsets), "part")
        .withColumn("start", start)
        .withColumn("shard", F.expr(f"cast(coalesce(least({n_shards - 1}, ((2 * start + size) * {n_shards}) div nullif(2 * total, 0)), 0) as int)"))
    )
    # One row per partition and shard that meet: partitions + shards at most.
    met = cut.groupBy("part", "shard").agg(F.count("*").alias("rows"))
    first = met.select("part", "shard", F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    slot = F.col("first") + F.row_number().over(W.partitionBy("part", "shard").orderBy(*order)) - 1
    return cut.join(F.broadcast(first), ["part", "shard"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def op1_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_by_size(table(spark, sf_dir, "documents"), 24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The table for CRC-32 byte by byte, from the reversed polynomial.
CRC32_STEPS = """
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8)"""
_CRC32_SQL = (
    CRC32_STEPS
    + """,
crcs AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h) // 2 + 1), lambda p: ('0x' || substring(h, 2 * p - 1, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT text, hex(encode(text)) AS h FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)), crc_table
)"""
)

OP1_SQL = (
    _CRC32_SQL
    + """, placed AS (
  SELECT doc_id, text, coalesce(strlen(text), 0) + 8 AS size FROM documents
), summed AS (
  SELECT p.doc_id, p.size, c.crc, coalesce(sum(p.size) OVER (ORDER BY p.doc_id NULLS FIRST, c.crc NULLS FIRST, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(p.size) OVER () AS total
  FROM placed p LEFT JOIN crcs c ON p.text = c.text
), cut AS (SELECT *, least(23, ((2 * start + size) * 24) // (2 * total)) AS shard FROM summed)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc NULLS FIRST, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut"""
)
