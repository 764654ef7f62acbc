"""Line dedup across sites: lines that many distinct sites carry are boilerplate and go.

Each line's hash gathers a HyperLogLog sketch of its sites, once its plain count reaches the threshold;
sketches merge in partial aggregation, so a line that a third of all rows carry costs each task one row.
Only where an estimate is near the threshold are the line's sites counted exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: A line is boilerplate from so many distinct sites on.
MIN_SITES = 5
#: Registers 2^10: a standard error of about 3 %, so the bounds below are dozens of errors away.
LG_K = 10
SURE, NEAR = 2.0, 0.5
#: Common lines (hashes of 8 bytes) that are broadcast at most; beyond it lines are shuffled to them.
BROADCAST_LINES = 500_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """A line's hash without white space at its ends; null for a blank line."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare != "", F.xxhash64(bare))


def _sized(lines: DataFrame) -> DataFrame:
    """Hashes to join with: broadcast up to BROADCAST_LINES, so that no line's rows meet in one task."""
    return F.broadcast(lines) if lines.count() <= BROADCAST_LINES else lines


def common_lines(lines: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    """(line) hashes that `min_sites` sites or more carry, from (line, site) rows; null sites don't count.

    A line has no more sites than rows, so plain counts first leave out the many that are rare.
    """
    sited = lines.where("site is not null")
    frequent = scratch.write(sited.groupBy("line").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_sites).select("line"))
    few = sited.join(_sized(frequent), "line", "left_semi")
    sketched = scratch.write(few.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate")))
    sure = sketched.where(F.col("estimate") >= SURE * min_sites).select("line")
    near = sketched.where((F.col("estimate") >= NEAR * min_sites) & (F.col("estimate") < SURE * min_sites)).select("line")
    # A line's sites once each: what a third of all rows carry is a few rows of each task.
    exact = sited.join(_sized(near), "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.union(exact.select("line"))


def _held(sent):
    """Of each text's line keys those in the broadcast ones, which are sorted."""

    @F.arrow_udf("array<bigint>")
    def of(keys: pa.Array) -> pa.Array:
        flat = keys.flatten()
        known = np.isin(flat.to_numpy(zero_copy_only=False), sent.value) if len(flat) else np.zeros(0, bool)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(keys), 0), np.int64)
        upto = np.concatenate(([0], np.cumsum(known)))
        offsets = upto[np.concatenate(([0], np.cumsum(sizes)))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(pa.array(known, pa.bool_())))

    return of.asNondeterministic()  # so that Spark runs it once a row


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, scratch: Scratch | None = None) -> DataFrame:
    """(id, text, n_lines, n_removed) for every row: the text without lines that `min_sites` sites carry.

    Lines end at a line feed and are compared without white space at their ends. Blank lines stay. Null
    text stays null with no lines; empty text is one blank line. A row without a site keeps its lines'
    say out of the count but loses boilerplate like any other. Repeated rows stay rows. An empty table
    gives no rows; other columns are not read.

    Up to BROADCAST_LINES common lines go to the texts, which are not moved; more are met by a join.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).alias("site"))
    keys = F.array_compact(F.array_distinct(F.transform(_lines(F.col("text")), _key)))
    slim = scratch.write(own.select("id", "site", F.xxhash64("text").alias("text_hash"), keys.alias("lines")))
    each = slim.select("id", "text_hash", "site", F.explode("lines").alias("line"))
    common = scratch.write(common_lines(each.select("line", "site"), scratch, min_sites))
    if common.count() <= BROADCAST_LINES:
        held = np.sort(common.toArrow().column("line").to_numpy())
        found = own.withColumn("keys", keys)
        rows = found.select("id", "text", _held(docs.sparkSession.sparkContext.broadcast(held))(F.col("keys")).alias("common"))
    else:
        # As many values as the document has different lines, at most.
        marked = each.join(common, "line").groupBy("id", "text_hash").agg(F.collect_set("line").alias("common")).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "common")
        rows = own.withColumn("text_hash", F.xxhash64("text")).join(marked, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    keep = F.filter(_lines(F.col("text")), lambda line: ~F.coalesce(F.array_contains(F.col("common"), _key(line)), F.lit(False)))
    kept = F.when(F.coalesce(F.size("common"), F.lit(0)) <= 0, _lines(F.col("text"))).otherwise(keep)
    out = rows.select("id", "text", kept.alias("kept"), F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long").alias("n_lines"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text"),
        "n_lines",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_common_lines(table(spark, sf_dir, "documents"))


OP6_SQL = rf"""
WITH line AS (
  SELECT doc_id, text, source, line, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)
), common AS (SELECT bare FROM line WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES})
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.bare IS NULL), '') AS text, count(*) AS n_lines, count(c.bare) AS n_removed
FROM line LEFT JOIN common c ON line.bare = c.bare GROUP BY doc_id
"""
