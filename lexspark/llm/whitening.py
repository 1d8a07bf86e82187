"""Embedding whitening by matrix-free block subspace iteration.

Entries are put on a grid of 1/SCALE, so that counts, sums and deviations are exact whole numbers.  The fit list holds each
distinct vector once.  A pass over it computes X'(XQ) of the centred rows X and a block Q of directions: each task sums its rows'
share, Spark adds the shares by dimension, and the driver sees one number for each dimension and direction.  QR makes the next block,
Rayleigh-Ritz turns it to eigenvectors, and passes go on until the residual of all k components is at rounding.  No
covariance matrix is built: where eigenvalues lie apart, a block of BLOCK directions does with few passes.  Where they
hardly differ, the residuals fall too slowly, and the block is widened twofold until they do; at the latest a block
of all dimensions ends it.

Defined results: vectors that are null or hold null or non-finite entries are left out, and so are those of another length than
the commonest (of equally common ones the longest); rows repeated with one vec_id are rows of their own, equal vectors
count once in the fit; entries beyond a long become the nearest long; a deviation beyond a long is null; there are as many components as
directions with variance, so equal or single vectors, vectors without entries, and an empty table give an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.columns import pick
from lexspark.llm.storage import Scratch

SCALE, COMPONENTS = 256, 4
#: Directions of the first block; passes that residuals may still need before the block is widened.
BLOCK, PATIENCE = 16, 10
#: Residual, in terms of the largest eigenvalue, that counts as rounding; share of it below which a direction has no variance.
ROUNDING, NOTHING = 2e-13, 1e-11
#: Rows that a task multiplies at once.
ROWS = 4096


def on_grid(vector: Column) -> Column:
    """Whole numbers floor(SCALE * c) of the entries; null where the vector is not usable."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(vector.isNotNull() & fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


@dataclass
class Whitening:
    """What the passes found: values falls, vectors has a column for each value."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int
    block: int
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of the tasks' shares (i, row): a matrix with a row for each i."""
    total = parts.groupBy("i").agg(F.array(*[F.sum(F.col("row")[j]) for j in range(width)]).alias("row"))
    return np.array([r["row"] for r in sorted(total.collect(), key=lambda r: r["i"])])


def _product(fit: DataFrame, mean: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X'(XQ) over all rows, and each dimension's sum of squares."""
    size, width = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width + 1))
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                rows = _matrix(batch.column(0).slice(begin, ROWS), size) - mean
                total[:, :width] += rows.T @ (rows @ block)
                total[:, width] += np.einsum("ij,ij->j", rows, rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    found = _added(fit.mapInArrow(run, "i int, row array<double>"), width + 1)
    return found[:, :width], found[:, width]


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            rows = _matrix(batch.column(0), size)
            n += len(rows)
            wide = len(rows) and max(abs(int(rows.max())), abs(int(rows.min()))) * len(rows) >= 1 << 62
            total = [a + int(b) for a, b in zip(total, (rows.astype(object) if wide else rows).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([str(x) for x in [n, *total]])], names=["i", "x"])

    found = fit.mapInArrow(run, "i int, x string").groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    n, *total = [int(r["x"]) for r in sorted(found.collect(), key=lambda r: r["i"])] or [0]
    return n, total


def fit_whitening(fit: DataFrame, size: int, k: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """The first k components of a table x of distinct vectors, all of this size; None if no direction has variance."""
    n, sums = _sums(fit, size) if size else (0, [])
    if n < 2:
        return None
    mean, rng = np.array([s / n for s in sums]), np.random.default_rng(size)
    width = min(size, max(k, block))
    q = np.linalg.qr(rng.normal(size=(size, width)))[0]
    for step in range(1, 10_000):
        z, squares = _product(fit, mean, q)
        z, trace = z / n, float(squares.sum()) / n
        if not trace:
            return None
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        u, image = q @ turn, z @ turn
        residual = float(np.linalg.norm(image[:, :k] - u[:, :k] * values[:k], axis=0).max()) / values[0]
        if residual <= ROUNDING or width == size:
            break
        q = np.linalg.qr(image)[0]
        rate = max(values[-1], 0) / values[k - 1] if values[k - 1] > 0 else 0.0
        if rate >= 1 or (rate > 0 and math.log(residual / ROUNDING) > -math.log(rate) * PATIENCE):
            wider = min(size, 2 * width)
            extra = rng.normal(size=(size, wider - width))
            q, width = np.linalg.qr(np.hstack([q, extra]))[0], wider
    some = values[:k] > NOTHING * values[0]
    out = Whitening(n, sums, values[:k][some], u[:, :k][:, some], trace, residual, step, width)
    covered, _ = _product(fit, mean, out.projection)
    out.identity_error = float(np.abs(out.projection.T @ covered / n - np.eye(int(some.sum()))).max())
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - S) ** 2, exact; null beyond a long."""
    far = max(max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums)), 1) if len(x) else 1
    if far * far * len(sums) < 1 << 63:
        off = x * n - np.array(sums)
        return pa.array((off * off).sum(1))
    total = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return pa.array([int(t) if t < 1 << 63 else None for t in total], pa.int64())


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): vectors on the grid."""
    rows = pick(vectors, "vec_id", "embedding")
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), on_grid(F.col("embedding").cast("array<double>")).alias("x")).filter("x IS NOT NULL")


def whiten(rows: DataFrame, size: int, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): a list of components for each row of (vec_id, x) that has this size."""
    n, sums, mean, projection = model.n, model.sums, model.mean, model.projection

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                x = _matrix(part.column(1), size)
                yield pa.RecordBatch.from_arrays([part.column(0), _deviations(x, n, sums), pa.array(list((x - mean) @ projection), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return rows.filter(F.size("x") == size).mapInArrow(run, "vec_id bigint, deviation bigint, whitened array<double>")


def whitened_components(vectors: DataFrame, k: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row and component."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = scratch.save(usable_rows(vectors), "rows")
    common = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).head()
    size = common["size"] if common else 0
    # Copies of a vector are merged in the tasks that read them, before any shuffle.
    fit = scratch.save(rows.filter(F.size("x") == size).groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    model = fit_whitening(fit, size, k, block)
    if model is None:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(v) / model.trace) for v in model.values])
    long = whiten(rows, size, model).select("vec_id", "deviation", F.posexplode("whitened").alias("p", "whitened"))
    return long.select("vec_id", (F.col("p") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", explained[F.col("p")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))
