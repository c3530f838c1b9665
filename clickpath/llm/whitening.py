"""Embedding whitening by a distributed covariance and a symmetric eigensolver.

Spark sums the centred products of the distinct vectors; the matrix, whose
size is the dimension's square and does not grow with the rows, is solved on
the driver: Householder reflections make it tridiagonal, bisection on Sturm
counts finds the leading eigenvalues, and inverse iteration, orthogonalised
again within clusters of close eigenvalues, the eigenvectors. Mean and
components are broadcast and every vector is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickpath.llm.store import release, ship, stored

COMPONENTS = 16
#: Entries become whole numbers: ``floor(SCALE * c) + SHIFT``.
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on would not fit in a long after scaling; they count as non-finite.
TOO_LARGE = float(1 << 56)
#: Eigenvalues closer than this share of the matrix norm form a cluster.
CLUSTER = 1e-3


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit Householder vectors that make the symmetric ``a`` tridiagonal."""
    a, turns = a.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or size == abs(v[0]):
            turns.append(np.zeros(len(v)))
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = 2 * a[k + 1:, k + 1:] @ v
        w = p - (v @ p) * v
        a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] -= 2 * (v @ a[k + 1:, k]) * v
        turns.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each value of ``at``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q = diagonal[0] - at
    below = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        q = d - at - e * e / np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling; all are bisected at once until no double lies between the bounds."""
    around = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    low, high = float((diagonal - around).min()), float((diagonal + around).max())
    wide = max(abs(low), abs(high), np.finfo(float).tiny) * 1e-12
    low, high = np.full(count, low - wide), np.full(count, high + wide)
    rank = len(diagonal) - 1 - np.arange(count)
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        above = sturm_counts(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, floor: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves ``(T - shift) x = b`` by elimination with row exchanges; pivots are kept at ``floor`` at least."""
    n = len(diagonal)
    main, up, far = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    steps = []
    for k in range(n - 1):
        below, nxt, nxt_up = float(off[k]), main[k + 1], up[k + 1]
        if abs(below) > abs(main[k]):
            f = main[k] / below
            steps.append((True, f))
            main[k + 1], up[k + 1] = up[k] - f * nxt, far[k] - f * nxt_up
            main[k], up[k], far[k] = below, nxt, nxt_up
        else:
            if abs(main[k]) < floor:
                main[k] = floor
            f = below / main[k]
            steps.append((False, f))
            main[k + 1], up[k + 1] = nxt - f * up[k], nxt_up - f * far[k]
    if abs(main[-1]) < floor:
        main[-1] = floor

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for k, (swapped, f) in enumerate(steps):
            if swapped:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= f * x[k]
        for k in range(n - 1, -1, -1):
            rest = x[k]
            if k + 1 < n:
                rest -= up[k] * x[k + 1]
            if k + 2 < n:
                rest -= far[k] * x[k + 2]
            x[k] = rest / main[k]
        return np.array(x)

    return solve


def leading_eigenpairs(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of the symmetric ``a``, falling, and their unit eigenvectors as columns."""
    n = len(a)
    scale = float(np.abs(a).max())
    if scale == 0:
        return np.zeros(count), np.eye(n)[:, :count]
    diagonal, off, turns = tridiagonal(a / scale)
    values = leading_eigenvalues(diagonal, off, count)
    norm = float((np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))).max())
    eps = np.finfo(float).eps * norm
    rng, vectors, start, shift = np.random.default_rng(5), np.zeros((n, count)), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            start = j
        # equal eigenvalues get shifts a little apart, so that their solutions differ
        shift = min(value, shift - 2 * eps) if j > start else value
        solve = _solver(diagonal, off, shift, eps)
        x = rng.standard_normal(n)
        for _ in range(5):
            x = solve(x / np.linalg.norm(x))
            for _ in range(2):
                for i in range(start, j):
                    x = x - (vectors[:, i] @ x) * vectors[:, i]
        vectors[:, j] = x / np.linalg.norm(x)
    for k in range(len(turns) - 1, -1, -1):
        v = turns[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    return values * scale, vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(count)] < 0, -1, 1)


class Fit:
    """Mean and components of the vectors of one length; all that tasks need to whiten a vector."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.left = [s % n for s in sums]
        self.part = np.array([r / n for r in self.left])
        self.values, self.vectors, self.explained, self.error = np.zeros(0), np.zeros((len(sums), 0)), np.zeros(0), 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` without the mean; the whole part is taken off in integers, so nothing cancels."""
        return (x - self.whole).astype(np.float64) - self.part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def solve(self, products: np.ndarray, components: int) -> None:
        covariance = products / self.n
        values, vectors = leading_eigenpairs(covariance, min(components, len(covariance)))
        total = float(np.trace(covariance))
        real = values > len(covariance) * np.finfo(float).eps * total
        self.values, self.vectors, self.explained = values[real], vectors[:, real], values[real] / total if total else values[real]

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """``sum((n x - S)^2)`` of each row, exactly; None where that is no long."""
        y = x - self.whole
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if len(self.sums) * most * most < 1 << 63:
            d = self.n * y - np.array(self.left, np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * y.astype(object) - np.array(self.left, object)
        return [s if s < 1 << 63 else None for s in (d * d).sum(1).tolist()]


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole_numbers(vec: Column) -> Column:
    """The vector as longs; null if it is null or holds an entry that is null or not finite."""
    number = vec.cast("array<double>")
    sound = F.forall(number, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(TOO_LARGE)))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(number, lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT)))


def _sums(fit: DataFrame, length: int, per_batch: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all vectors of what ``per_batch`` makes of a batch; each task hands on one partial sum."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += per_batch(_rows(batch.column("x")))
        for at in range(0, size, 1 << 16):
            part = total[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part)], ["k", "v"])

    out = np.zeros(size)
    for k, v in fit.where(F.size("x") == length).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out


def _exact_sums(fit: DataFrame, length: int) -> list[int]:
    def run(batches):
        total = [0] * length
        for batch in batches:
            x = _rows(batch.column("x"))
            for k, (high, low) in enumerate(zip((x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist())):
                total[k] += (high << 32) + low
        yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int64()), pa.array([Decimal(s) for s in total], pa.decimal128(38, 0))], ["k", "v"])

    rows = fit.where(F.size("x") == length).mapInArrow(run, "k long, v decimal(38,0)").groupBy("k").agg(F.sum("v")).collect()
    return [int(v) for _, v in sorted(rows)]


def train(fit: DataFrame, length: int, n: int, components: int = COMPONENTS) -> Fit:
    """The components of the ``n`` distinct vectors ``fit (x)`` of one length, and how far whitened ones are from unit covariance."""
    model = Fit(n, _exact_sums(fit, length))
    upper = np.triu_indices(length)

    def products(x):
        y = model.centred(x)
        return (y.T @ y)[upper]

    matrix = np.zeros((length, length))
    matrix[upper] = _sums(fit, length, products, len(upper[0]))
    model.solve(matrix + np.triu(matrix, 1).T, components)
    k = len(model.values)

    def moments(x):
        w = model.whitened(x)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    if k:
        found = _sums(fit, length, moments, k + k * k) / n
        model.error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    return model


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every sound vector and component.

    Vectors that are null or hold a null, NaN or infinite entry (or one of
    2^56 or more) are left out. Equal vectors count once in the fit, however
    often they occur, and each row is returned. Vectors of different lengths
    are fitted apart, each length by a few jobs of its own; empty vectors
    have no component. Eigenvalues that are zero to rounding have no
    component, so a single distinct vector gives no rows. ``deviation`` is
    null where the exact number is no long. Null ids are returned as null. An
    empty table gives no rows; other columns are ignored. The driver holds
    matrices of length x length, whatever the number of rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vec_col)).alias("x")).where(F.size("x") > 0)
    base = stored(spark, base, "whole")
    fit = stored(spark, base.select("x").distinct(), "fit")
    out = spark.createDataFrame([], SCHEMA)
    for length, n in sorted(tuple(r) for r in fit.groupBy(F.size("x").alias("length")).count().collect()):
        shared = spark.sparkContext.broadcast(train(fit, length, n, components))
        out = out.union(_projected(base.where(F.size("x") == length), shared))
    release(fit)
    return out


def _projected(rows: DataFrame, shared) -> DataFrame:
    def run(batches):
        model: Fit = shared.value
        k = len(model.values)
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _rows(batch.column("x"))
            each = lambda column: column.take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([
                each(batch.column("vec_id")), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n)),
                each(pa.array(model.deviations(x), pa.int64())), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(len(x) * k, model.error))], [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
