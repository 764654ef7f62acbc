"""Embedding near-dedup with spherical-cap filters from random product codes.

After a random rotation a vector is cut into BLOCKS parts; each part has its own random code of unit
vectors, and every choice of one code word a part is a filter direction (Becker, Ducas, Gama and
Laarhoven 2016). A vector passes all filters whose direction it is near enough to. They are list-decoded:
sums over the first half of the parts and over the second are sorted, and only choices that reach the
threshold are walked. Vectors of one label that share a filter are candidates.

Equal vectors of a label are one row from the start, with a count: a vector that a third of all rows
hold costs no pairs. The number of filters follows the number of vectors, so a filter's vectors stay few
unless they are near each other. A filter of up to SMALL vectors lists its candidates: 128 sign bits drop
most that are far apart, and the cosine of the rest is taken in double precision. A larger one (a cluster
of near vectors) is cut into blocks; each pair of blocks is a task's matrix product, which gives numbers
of links and a spanning forest, never the pairs. Two vectors that share a large filter are counted at the
least one that they share, and are no candidates elsewhere.

Decoding costs the square root of the number of filters a vector, some 2 ms at 10^9 vectors; more BLOCKS
would cost less there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import Scratch, default_partitions, table
from .components import connected_components

COSINE = 0.98
BLOCKS = 4
#: Filters that a vector passes, in expectation, and at least.
PASSED, LEAST = 24, 16
#: Steps, in deviations of a filter's cosine, by which the threshold of a vector that passes fewer is lowered.
STEP = 0.2
SIGN_BITS = 128
#: Vectors of a filter whose candidates are listed, and of a block of a larger one.
SMALL, BLOCK = 128, 1024


class CapFilters:
    """Filters for vectors of one dimension; all that is random follows from the seed."""

    def __init__(self, dim: int, rows: int, seed: int = 5):
        rng = np.random.default_rng((seed, dim))
        self.size = max(8, math.ceil((8 * rows) ** (1 / BLOCKS)))
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.bounds = np.linspace(0, dim, BLOCKS + 1).astype(int)
        self.codes = []
        for a, b in zip(self.bounds, self.bounds[1:]):
            code = rng.normal(size=(self.size, b - a)) if b > a else np.zeros((self.size, 0))
            self.codes.append(code / np.maximum(1e-300, np.linalg.norm(code, axis=1, keepdims=True)) / math.sqrt(BLOCKS))
        self.step = STEP / math.sqrt(dim)
        self.threshold = NormalDist().inv_cdf(1 - PASSED / self.size**BLOCKS) / math.sqrt(dim)
        self.planes = rng.normal(size=(dim, SIGN_BITS))
        #: Bits in which vectors at the cosine differ, and six deviations.
        p = math.acos(COSINE) / math.pi
        self.most_bits = math.ceil(SIGN_BITS * p + 6 * math.sqrt(SIGN_BITS * p * (1 - p)))

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """The filters that each unit vector passes, as numbers."""
        turned = units @ self.rotation
        parts = [turned[:, a:b] @ c.T for a, b, c in zip(self.bounds, self.bounds[1:], self.codes)]
        pairs = self.size**2
        out = []
        for row in range(len(units)):
            first, second = ((parts[i][row][:, None] + parts[i + 1][row][None]).ravel() for i in (0, 2))
            by_second = np.argsort(second)
            ranked, best, need = second[by_second], second.max(), self.threshold
            while True:
                near = np.flatnonzero(first >= need - best)
                starts = np.searchsorted(ranked, need - first[near])
                counts = pairs - starts
                if counts.sum() >= min(LEAST, pairs):
                    break
                need -= self.step
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            out.append(np.repeat(near, counts) * pairs + by_second[np.repeat(starts, counts) + within])
        return out

    def signs(self, units: np.ndarray) -> np.ndarray:
        """(n, 2) longs of sign bits."""
        return np.packbits(units @ self.planes > 0, axis=1).view(np.int64)


def _filter_batches(rows: int):
    made: dict[int, CapFilters] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, labels = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            vectors = batch.column(2).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                filters = made.get(dim) or made.setdefault(dim, CapFilters(dim, rows))
                x = np.array([vectors[i] for i in at], np.float64)
                units = x / np.linalg.norm(x, axis=1, keepdims=True)
                passed, signs = filters.decode(units), filters.signs(units)
                counts = np.array([len(p) for p in passed])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(reps[at], counts)), pa.array([labels[i] for i, n in zip(at, counts) for _ in range(n)], pa.string()), pa.array(np.full(counts.sum(), dim), pa.int32()), pa.array(np.concatenate(passed).astype(np.int64)), pa.array(np.repeat(signs[:, 0], counts)), pa.array(np.repeat(signs[:, 1], counts)), pa.array(np.full(counts.sum(), filters.most_bits), pa.int32())],
                    ["rep", "label", "dim", "cap", "s1", "s2", "most"],
                )

    return run


@F.arrow_udf(DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of two columns of lists of equal lengths, in double precision."""
    x, y = (np.asarray(v.flatten(), np.float64) for v in (a, b))
    starts = np.concatenate(([0], np.cumsum(pc.list_value_length(a))[:-1])).astype(np.int64) if len(a) else np.zeros(0, np.int64)
    dot = lambda u, v: np.add.reduceat(u * v, starts) if len(starts) else np.zeros(0)
    return pa.array(dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)))


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by filter come in, candidates go out: those whose sign bits are near and that share no large filter.

    A filter holds SMALL rows at most, so each row meets the next few by shifts of whole columns.
    """
    kept: tuple | None = None

    def pairs(group: np.ndarray, reps: np.ndarray, signs: np.ndarray, most: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
        found = []
        for step in range(1, min(SMALL, len(reps))):
            at = np.flatnonzero((group[step:] == group[:-step]).all(axis=1))
            if not len(at):
                break
            near = np.bitwise_count(signs[at] ^ signs[at + step]).sum(axis=1, dtype=np.int64) <= most[at]
            found.append(np.stack([at[near], at[near] + step]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        elsewhere = [wide[i] is not None and wide[j] is not None and bool(set(wide[i]) & set(wide[j])) for i, j in zip(a, b)]
        left = ~np.array(elsewhere, bool)
        a, b = reps[a[left]], reps[b[left]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["rep_a", "rep_b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]]
        wide = np.empty(batch.num_rows, object)
        wide[:] = batch.column(7).to_pylist()
        rows = np.stack(columns[:3], axis=1), columns[3], np.stack(columns[4:6], axis=1).view(np.uint64), columns[6], wide
        if kept is not None:
            rows = tuple(np.concatenate(x) for x in zip(kept, rows))
        if not len(rows[1]):
            continue
        last = np.flatnonzero((rows[0] != rows[0][-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        kept = tuple(x[cut:] for x in rows)
        if cut:
            yield pairs(*(x[:cut] for x in rows))
    if kept is not None and len(kept[1]):
        yield pairs(*kept)


def _spanning(links: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    left, a, b = np.ones(len(links), bool), [], []
    for root in range(len(links)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue:
            top = queue.pop()
            got = np.flatnonzero(links[top] & left)
            left[got] = False
            a += [top] * len(got)
            b += got.tolist()
            queue += got.tolist()
    return a, b


def _block_batches(least: float):
    """Rows sorted by (filter, pair of blocks) come in; (rep, others, None) with links of a vector and
    (rep, None, to) with edges of a forest go out."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        mine = rows[0][2]
        first, second = rows[0][3], rows[0][4]
        block = np.array([r[5] for r in rows])
        reps, weight = np.array([r[6] for r in rows], np.int64), np.array([r[7] for r in rows], np.int64)
        x = np.array([r[8] for r in rows], np.float64)
        units = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        near = units @ units.T >= least
        np.fill_diagonal(near, False)
        if first != second:
            near &= block[:, None] != block[None]  # pairs within a block have a task of their own
        # A pair is counted at the least large filter that it shares.
        earlier = sorted({c for r in rows for c in r[9] if c < mine})
        counted = near
        if earlier:
            place = {c: k for k, c in enumerate(earlier)}
            held = np.zeros((len(rows), len(earlier)), np.float32)
            for i, r in enumerate(rows):
                held[i, [place[c] for c in r[9] if c < mine]] = 1
            counted = near & (held @ held.T == 0)
        others = counted @ weight
        a, b = _spanning(near)
        some = np.flatnonzero(others)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([reps[some], reps[a]]).astype(np.int64)), pa.concat_arrays([pa.array(others[some], pa.int64()), none(len(a))]), pa.concat_arrays([none(len(some)), pa.array(reps[b].astype(np.int64))])],
            ["rep", "others", "to"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if kept and kept[-1][:5] != row[:5]:
                    yield links(kept)
                    kept = []
                kept.append(row)
        if kept:
            yield links(kept)

    return run


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = COSINE, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors link at a cosine of `least` (0.98 or more) within a label. Null labels, null or zero vectors
    and vectors with null or non-finite components link with nothing, vectors of other dimensions neither.
    Repeated rows stay rows and link with each other. Ids should be unique; a null id counts as a link
    but is never a component's id. An empty table gives no rows; other columns are not read. Vectors are
    told apart by 128 bits of hashes.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark)
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # one zero
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    hashed = lambda seed: F.when(good, F.xxhash64(F.lit(seed), "label", F.size("v"), "v"))
    keyed = scratch.write(own.select("id", "label", "v", hashed(1).alias("h1"), hashed(2).alias("h2")))
    grouped = keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least_id"))
    reps = scratch.write(grouped.withColumn("rep", F.monotonically_increasing_id()))
    parts = max(spark.sparkContext.defaultParallelism, default_partitions(spark))
    spread = reps.select("rep", "label", "v").repartition(parts, "rep")
    caps = scratch.write(spread.mapInArrow(_filter_batches(reps.count()), "rep long, label string, dim int, cap long, s1 long, s2 long, most int"))
    cap = ["label", "dim", "cap"]
    large = scratch.write(caps.groupBy(*cap).agg(F.count("*").alias("vectors")).where(F.col("vectors") > SMALL))
    within = scratch.write(caps.join(large, cap).select(*cap, "rep", "vectors"))
    wide = scratch.write(within.groupBy("rep").agg(F.collect_list("cap").alias("wide")))  # the filters of one vector

    # Labels meet by a hash here; that they are equal is told with the vectors.
    listed = caps.join(large, cap, "left_anti").join(wide, "rep", "left").select(F.xxhash64("label").alias("label"), F.col("dim").cast("long"), "cap", "rep", "s1", "s2", "most", "wide")
    pairs = listed.repartition(parts, *cap).sortWithinPartitions(*cap).mapInArrow(_pair_batches, "rep_a long, rep_b long").distinct()
    vector = lambda side: reps.select(F.col("rep").alias("rep_" + side), F.col("label").alias("label_" + side), F.col("v").alias("v_" + side), F.col("n").alias("n_" + side))
    links = scratch.write(pairs.join(vector("a"), "rep_a").join(vector("b"), "rep_b").where("label_a = label_b").where(cosine("v_a", "v_b") >= least).select("rep_a", "rep_b", "n_a", "n_b"))

    blocks = F.ceil(F.col("vectors") / BLOCK).cast("long")
    cut = within.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    each = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = each.select(*cap, F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "rep")
    filled = placed.join(reps.select("rep", "n", "v"), "rep").join(wide, "rep").select(*cap, "first", "second", "block", "rep", "n", "v", "wide")
    group = [*cap, "first", "second"]
    found = scratch.write(filled.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(_block_batches(least), "rep long, others long, to long"))
    scratch.drop(caps)

    ends = links.select(F.col("rep_a").alias("rep"), F.col("n_b").alias("n")).union(links.select(F.col("rep_b").alias("rep"), F.col("n_a").alias("n"))).union(found.where("others is not null").select("rep", "others"))
    linked = ends.groupBy("rep").agg(F.sum("n").alias("others"))
    edges = links.select("rep_a", "rep_b").union(found.where("to is not null").select("rep", "to"))
    roots = connected_components(edges, "rep_a", "rep_b", scratch).withColumnRenamed("node", "rep")
    rooted = reps.select("rep", "h1", "h2", "n", "least_id").join(roots, "rep", "left").join(linked, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(ids, "root").select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = keyed.select("id", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_cap_filter_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
