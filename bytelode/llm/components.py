"""Connected components of a graph given as edge rows: alternating large-star and small-star
rounds (Kiveris et al. 2014), all on DataFrames; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Rows of a node from which its minimum is broadcast, at least; and nodes that have so many rows, at most.
HEAVY, MOST_HEAVY = 500, 100_000


def _downward(edges: DataFrame) -> DataFrame:
    """Edges as (u, v) with u > v, once each."""
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _with_low(rows: DataFrame, least: DataFrame, heavy: int) -> DataFrame:
    """Adds to rows (u, v) the `low` of u from `least` (u, low, n). Minima of nodes with more than `heavy` rows are
    broadcast, so that the centre of a star is no key of a shuffle."""
    known = F.broadcast(least.where(F.col("n") > heavy).select("u", "low"))
    marked = rows.join(known, "u", "left")
    usual = marked.where("low is null").select("u", "v").join(least.where(F.col("n") <= heavy).select("u", "low"), "u")
    return marked.where("low is not null").union(usual.select("u", "v", "low"))


def _large_star(edges: DataFrame, heavy: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("n"))
    return _with_low(both, least, heavy).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame, heavy: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    hung = _with_low(edges, least, heavy).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.union(least.select("u", F.col("low").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Null ends and self-loops link nothing. Empty edges give an empty table.
    """
    links = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = scratch.write(_downward(links.dropna()))
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen or state["n"] == 0:
            break
        seen = state
        heavy = max(HEAVY, 2 * state["n"] // MOST_HEAVY)
        grown = scratch.write(_downward(_large_star(now, heavy)))
        scratch.drop(now)
        now = scratch.write(_downward(_small_star(grown, heavy)))
        scratch.drop(grown)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
