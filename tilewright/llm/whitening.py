"""Embedding whitening: principal components by a randomised range finder, and rows projected on them.

1. Entries become whole numbers, ``floor(1024 c) + 100000``; rows whose vector is null or has a null or
   non-finite entry are left out, and so are rows of another length than most vectors have. The rest is
   written once as arrays of longs. Counts and per-dimension sums are exact.
2. A random test matrix of ``components + OVERSAMPLE`` columns is multiplied by the covariance in one pass
   over all centred rows (each task adds up its own product, tasks' products are summed by entry);
   its orthonormal basis goes through ``PASSES`` more such passes.
3. Rayleigh-Ritz: the covariance within the basis gives values and vectors. If the residual of any wanted
   vector is still above ``RESIDUAL`` of the largest value after these passes, the basis is expanded to
   full dimension, where it spans everything and one more pass gives the exact result.
4. A last pass projects all rows; their own covariance gives the distance from the identity.

What reaches the driver is of the size dimension x columns, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import read_table, staged

COMPONENTS = 8
OVERSAMPLE = 8
PASSES = 2
RESIDUAL = 1e-13
SEED = 20240
SCALE, SHIFT = 1024, 100_000
#: Values of less than this share of the largest are rounding: no component.
NO_VARIANCE = 1e-12
_LONG = 2**63


@dataclass(frozen=True)
class Whitening:
    """n rows with the sums ``sums``; unit ``vectors`` (dimension x components) of the covariance with ``values``, falling; its trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(rows: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the rows that count, x as longs; an entry that is no long after scaling counts as non-finite."""
    rows = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("c")).where("c is not null and size(c) > 0")
    rows = rows.where(f"forall(c, v -> v is not null and not isnan(v) and abs({scale}d * v) < 4e18d)")
    whole = staged(rows.select("vec_id", F.expr(f"transform(c, v -> cast(floor({scale}d * v) as bigint) + {shift}L)").alias("x")), "whole-vectors")
    sizes = whole.groupBy(F.size("x").alias("d")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return whole.where(F.size("x") == (most.d if most else 0))


def _vectors(batch: pa.RecordBatch, at: int, dimension: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _summed(vectors: DataFrame, dimension: int, start: np.ndarray, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the matrices that ``add`` makes of blocks of rows: a partial sum in each task, then a sum of each entry."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(start)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                total += add(_vectors(batch.slice(at, 4096), 0, dimension))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "v"])

    kind = "bigint" if start.dtype == np.int64 else "double"
    sums = vectors.select("x").mapInArrow(part, f"place bigint, v {kind}").groupBy("place").agg(F.sum("v").alias("v"))
    out = start.copy().ravel()
    table = sums.toArrow()
    out[table["place"].to_numpy()] = table["v"].to_numpy()
    return out.reshape(start.shape)


def _residuals(product: np.ndarray, basis: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Rayleigh-Ritz values and vectors within ``basis`` of the covariance, given covariance x basis, and the largest residual of the first k over the largest value."""
    inner = basis.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    left = np.linalg.norm(product @ turn - basis @ turn * values, axis=0)
    return values, basis @ turn, float(left.max() / values[0]) if values[0] > 0 else 0.0


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, *, oversample: int = OVERSAMPLE, passes: int = PASSES) -> Whitening | None:
    """The first ``components`` principal components of (vec_id, x) rows; None without rows.

    There are fewer if the dimension is smaller, or if the covariance has fewer values above rounding:
    a direction in which the rows don't differ has no scale to divide by.
    """
    first = vectors.select("x").first()
    if first is None:
        return None
    d, n = len(first.x), vectors.count()
    # sums of longs: a block's sum fits, and the sum over all rows is a decimal, whatever n is
    sums = _exact_sums(vectors, d)
    mean = np.array([s / n for s in sums])

    def covariance_times(q: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)
        return _summed(vectors, d, np.zeros((d, q.shape[1])), add) / n

    def squares(x: np.ndarray) -> np.ndarray:
        return np.array([((x - mean) ** 2).sum()])

    trace = float(_summed(vectors, d, np.zeros(1), squares)[0]) / n
    columns, k, source = min(d, components + oversample), min(d, components), np.random.default_rng(SEED)
    basis, residual = np.linalg.qr(source.standard_normal((d, columns)))[0], np.inf
    for _ in range(1 + passes):
        product = covariance_times(basis)
        values, found, residual = _residuals(product, basis, k)
        if residual <= RESIDUAL or columns == d:
            break
        basis = np.linalg.qr(product)[0]
    if residual > RESIDUAL and columns < d:
        basis = np.linalg.qr(np.hstack([basis, source.standard_normal((d, d - columns))]))[0]
        values, found, residual = _residuals(covariance_times(basis), basis, k)
    keep = values > NO_VARIANCE * max(trace, 1e-300)
    return Whitening(n, tuple(sums), found[:, keep], values[keep], trace)


def _exact_sums(vectors: DataFrame, d: int) -> list[int]:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _vectors(batch, 0, d)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            high += (x >> 32).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(low), pa.array(high)], ["place", "low", "high"])

    sums = vectors.select("x").mapInArrow(part, "place bigint, low bigint, high bigint").groupBy("place").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    out = [0] * d
    for r in sums.collect():
        out[r.place] = (r.high << 32) + r.low
    return out


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sums over the dimensions of (n x - S)^2, exact; None for one that is no long."""
    # a whole number near the mean comes off first, so that the numbers are small where the rows are near each other
    centre = [s // n for s in sums]
    if max(map(abs, centre), default=0) < 2**62 and abs(x).max(initial=0) < 2**62:
        near, rest = x - np.array(centre, np.int64), np.array([s - n * c for s, c in zip(sums, centre)], np.int64)
        about = ((n * near.astype(float) - rest) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            fits = ((n * near - rest) ** 2).sum(axis=1)
    else:
        about, fits = np.full(len(x), float(_LONG)), np.zeros(len(x), np.int64)
    out: list[int | None] = []
    for i, (size, fit) in enumerate(zip(about.tolist(), fits.tolist())):
        exact = fit if size < 0.99 * _LONG else sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums)) if size < 1.01 * _LONG else _LONG
        out.append(exact if exact < _LONG else None)
    return out


def whiten(vectors: DataFrame, fitted: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each row of (vec_id, x) and component.

    identity_error is one value: the largest absolute entry of the covariance of ``whitened`` minus the
    identity, summed over all rows. deviation is null where it exceeds a long. Repeated ids stay. Without
    rows, or where all rows are equal, the result is empty.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if fitted is None or not fitted.values.size:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, k, d = fitted.n, fitted.sums, len(fitted.values), len(fitted.sums)
    mean, turn = fitted.mean, fitted.vectors / np.sqrt(fitted.values)
    centre = _summed(vectors, d, np.zeros(k), lambda x: ((x - mean) @ turn).sum(axis=0)) / n

    def outer(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn - centre
        return w.T @ w

    error = float(np.abs(_summed(vectors, d, np.zeros((k, k)), outer) / n - np.eye(k)).max())
    explained = fitted.values / fitted.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x, m = _vectors(batch, 1, d), batch.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(_deviations(x, n, sums), pa.int64()).take(each),
                    pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "x").mapInArrow(project, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    vectors = whole_vectors(read_table(spark, sf_dir, "embeddings"))
    return whiten(vectors, fit_whitening(vectors))
