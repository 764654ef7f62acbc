"""Embedding whitening by a tiled covariance.

The fit list's distinct vectors are cut into row blocks and these into column blocks of TILE dimensions. A tile is a
pair of column blocks; each column block goes, by row block, to all tiles it is part of, the pairs are centred and
multiplied there, and products are summed by tile. So a task holds one pair of column blocks and one tile,
whatever the dimension and the number of vectors. The driver assembles the covariance, as large as the
dimension squared, and takes its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, default_partitions, table

#: Components that are taken, and what a vector's entries are multiplied by before they are cut to integers.
COMPONENTS, SCALE = 4, 256
#: Dimensions of a column block, and vectors of a row block.
TILE, ROWS = 32, 4096
_OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _row_blocks(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _matrix(part.column(column), dims)


def _sum_batches(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for _, x in _row_blocks(batches, 0, dims):
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total), pa.array(np.full(dims, n))], ["dim", "s", "n"])

    return run


def _column_batches(dims: int):
    """Rows (block, cols, kind, data): the integers of a row block's column block, in as few bytes as hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for _, x in _row_blocks(batches, 0, dims):
            kind = np.result_type(*(np.min_scalar_type(int(v)) for v in (x.min(), x.max())), np.int8)
            cells = [x[:, at : at + TILE].astype(kind).tobytes() for at in range(0, dims, TILE)]
            n = len(cells)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([kind.str] * n), pa.array(cells, pa.binary())], ["block", "cols", "kind", "data"])
            block += 1

    return run


def _tile_batches(mean: np.ndarray):
    """Rows (a, b, block, cols, kind, data) by tile and block come in, (a, b, part, product) go out: a row for each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tile, total, first = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([tile[0]], pa.int32()), pa.array([tile[1]], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["a", "b", "part", "product"])

        for batch in batches:
            for a, b, _, cols, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != tile:
                    if tile is not None:
                        yield done()
                    tile, total = (a, b), 0.0
                middle = mean[cols * TILE : (cols + 1) * TILE]
                x = np.frombuffer(data, kind).reshape(-1, len(middle)) - middle
                if cols == a:
                    first = x
                if cols == b:
                    total = total + first.T @ x
        if tile is not None:
            yield done()

    return run


def _add_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of one tile, in order, become one."""
    tile, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([tile[0]], pa.int32()), pa.array([tile[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["a", "b", "product"])
    for batch in batches:
        for a, b, _, product in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, b) != tile:
                if tile is not None:
                    yield row()
                tile, total = (a, b), 0.0
            total = total + np.frombuffer(product)
    if tile is not None:
        yield row()


def covariance(fit: DataFrame, mean: np.ndarray, n: int, scratch: Scratch) -> np.ndarray:
    """The covariance of all rows (x array<long>) around `mean`, divisor n."""
    dims, parts = len(mean), default_partitions(fit.sparkSession)
    blocks = scratch.write(fit.mapInArrow(_column_batches(dims), "block long, cols int, kind string, data binary"))
    count = -(-dims // TILE)
    pair = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.struct(F.least("cols", k).alias("a"), F.greatest("cols", k).alias("b")))
    tiles = blocks.withColumn("tile", F.explode(pair)).select("tile.a", "tile.b", "block", "cols", "kind", "data")
    dealt = tiles.repartition(parts, "a", "b", "block").sortWithinPartitions("a", "b", "block", "cols")
    products = scratch.write(dealt.mapInArrow(_tile_batches(mean), "a int, b int, part int, product binary"))
    summed = products.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "part").mapInArrow(_add_batches, "a int, b int, product binary")
    out = np.zeros((dims, dims))
    for row in summed.collect():  # the tiles of one matrix, dims x dims
        at, to = slice(row.a * TILE, (row.a + 1) * TILE), slice(row.b * TILE, (row.b + 1) * TILE)
        out[at, to] = np.frombuffer(row.product).reshape(out[at, to].shape)
        out[to, at] = out[at, to].T
    return out / n


@dataclass
class Whitening:
    """Centring at sums / n, then a projection on components (rows), each over the root of its eigenvalue."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - sums) squared, in integers; None beyond a long."""
        most = self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0))
        kind = np.int64 if x.shape[1] * most**2 < 1 << 63 else object
        away = x.astype(kind) * self.n - self.sums.astype(kind)
        return [d if d < 1 << 63 else None for d in map(int, (away * away).sum(axis=1))]


def eigen(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) by falling value, `most` of them at most and those above rounding only.

    A vector's largest entry is positive.
    """
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(values.max(initial=0), 0) * len(values) * 1e-14]
    rows = vectors[:, order].T
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]) if len(rows) else np.ones(0)
    return values[order], rows * signs[:, None]


def _moment_batches(model: Whitening):
    """A row (n, mean, scatter) for each task: of its whitened vectors, centred in each block before they are multiplied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = (0, np.zeros(len(model.values)), np.zeros((len(model.values),) * 2))
        for _, x in _row_blocks(batches, 0, len(model.sums)):
            w = model.whiten(x)
            mean = w.mean(axis=0)
            moments = _merged(moments, (len(w), mean, (w - mean).T @ (w - mean)))
        yield pa.RecordBatch.from_arrays([pa.array([moments[0]]), pa.array([moments[1].tolist()], pa.list_(pa.float64())), pa.array([moments[2].ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "scatter"])

    return run


def _merged(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def fit_whitening(fit: DataFrame, dims: int, most: int = COMPONENTS, scratch: Scratch | None = None) -> Whitening | None:
    """From distinct integer vectors (x array<long>) of `dims` entries; None where they don't vary."""
    scratch = scratch or Scratch(fit.sparkSession)
    totals = fit.mapInArrow(_sum_batches(dims), "dim long, s long, n long").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # a row for each dimension
    totals = sorted(totals)
    n, sums = totals[0].n if totals else 0, np.array([r.s for r in totals], np.int64)
    if not n:
        return None
    cov = covariance(fit, sums / n, n, scratch)
    values, rows = eigen(cov, most)
    if not len(values):
        return None
    model = Whitening(n, sums, rows, values, values / np.trace(cov))
    moments = (0, 0.0, 0.0)
    # A row of a few numbers for each task.
    for r in fit.mapInArrow(_moment_batches(model), "n long, mean array<double>, scatter array<double>").where("n > 0").collect():
        moments = _merged(moments, (r.n, np.array(r.mean), np.array(r.scatter).reshape(len(values), -1))) if moments[0] else (r.n, np.array(r.mean), np.array(r.scatter).reshape(len(values), -1))
    model.identity_error = float(np.abs(moments[2] / moments[0] - np.eye(len(values))).max())
    return model


def _whiten_batches(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for part, x in _row_blocks(batches, 1, len(model.sums)):
            each = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(model.deviation(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.n)), deviation.take(pa.array(each)), pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(each), model.identity_error))],
                [f.split()[0] for f in _OUT.split(", ")],
            )

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, scratch: Scratch | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each vector and component up to `most`.

    Rows without a vector, with null or non-finite entries, or of another length than most rows have (of
    equally frequent lengths the longest counts) are left out. Entries times `scale` are cut to integers; the fit list holds each
    different vector once. Repeated rows and null ids stay rows. Where the vectors vary in fewer directions there are fewer
    components; where they don't vary, and for an empty table, no rows. A deviation beyond a long is null. Other columns
    are not read.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    finite = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    good = scratch.write(rows.where(finite).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x")))
    usual = good.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("dims")).first()
    model = None
    if usual is not None and usual.dims > 0:
        own = good.where(F.size("x") == usual.dims)
        model = fit_whitening(scratch.write(own.select("x").distinct()), usual.dims, most, scratch)
    if model is None:
        found = rows.sparkSession.createDataFrame([], _OUT)
    else:
        found = own.select("id", "x").mapInArrow(_whiten_batches(model), _OUT)
    return found.withColumnRenamed("id", id_col)


def op12_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
