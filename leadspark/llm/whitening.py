"""Embedding whitening by mixed-precision eigenvectors of a distributed covariance.

Spark adds up the exact integer moments of the distinct vectors: their components are shifted by a whole number close to the mean before they are
multiplied, so nothing cancels, and what is left of the mean is taken out by exact arithmetic. The eigenvectors of the covariance
are first found in single precision; Ogita-Aishima iterations of matrix products in extended precision then correct all of
them at once and double their right digits each time. Eigenvalues that are too close for the present precision form a cluster:
the iteration makes its vectors span the right space, and a sub-solve of the small matrix of the cluster,
shifted by its mean eigenvalue and scaled up, separates them, by the same method.

The driver gets d sums and d x d products and sends back d x 16 numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import discard, stored

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LIMIT = 1 << 31             # scaled entries are kept within +-LIMIT
ROUNDS = 12                 # most iterations of one solve; 3 to 5 do
TINY = float(np.finfo(np.longdouble).eps)

_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vector: str, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each entry as double; null where the vector is null or has null or non-finite entries."""
    x = F.col(vector)
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(good, F.transform(x, lambda c: (F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c.cast("double") * scale))) + shift).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


# moments

def _sums(d: int):
    """Arrow mapper from (x) to one row for each task: count and sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=np.int64)
        for batch in batches:
            n, total = n + batch.num_rows, total + _matrix(batch.column(0), d).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[n, *total.tolist()]], pa.list_(pa.int64()))], ["values"])
    return run


def _products(centre: np.ndarray):
    """Arrow mapper from (x) to d rows for each task: exact sums of products of the shifted entries, as decimal text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(centre)
        total = np.zeros((d, d), dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), d) - centre
            reach = int(np.abs(x).max(initial=0))
            rows = (1 << 53) // max(1, reach * reach)
            if not rows:            # products beyond 2^53
                total += x.astype(object).T @ x.astype(object)
            for at in range(0, len(x) if rows else 0, max(1, min(rows, 1 << 16))):
                part = x[at:at + max(1, min(rows, 1 << 16))].astype(np.float64)
                total += (part.T @ part).astype(np.int64).astype(object)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([[str(v) for v in row] for row in total], pa.list_(pa.string()))], ["i", "values"])
    return run


def _added(parts: DataFrame, *keys: str) -> list:
    """Sums over the tasks, by place in the list."""
    exploded = parts.select(*keys, F.posexplode("values").alias("j", "v"))
    return exploded.groupBy(*keys, "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()


class Moments:
    """Count, sums and covariance of the distinct vectors; the covariance in extended precision."""

    def __init__(self, fit: DataFrame, d: int):
        sums = {r["j"]: int(r["v"]) for r in _added(fit.mapInArrow(_sums(d), "values array<long>"))}
        self.n, self.sums = sums.get(0, 0), [sums.get(j + 1, 0) for j in range(d)]
        if not self.n:
            return
        self.centre = [round(Fraction(s, self.n)) for s in self.sums]
        self.rest = [s - self.n * m for s, m in zip(self.sums, self.centre)]          # n times the mean of the shifted entries
        q = {(r["i"], r["j"]): int(r["v"]) for r in _added(fit.mapInArrow(_products(np.array(self.centre)), "i int, values array<string>"), "i")}
        self.covariance = np.array([[_extended(Fraction(self.n * q.get((i, j), 0) - self.rest[i] * self.rest[j], self.n * self.n)) for j in range(d)]
                                    for i in range(d)], dtype=np.longdouble).reshape(d, d)


def _extended(value: Fraction) -> np.longdouble:
    high = float(value)
    return np.longdouble(high) + np.longdouble(float(value - Fraction(high)))


# eigenvectors

def _norm(a: np.ndarray) -> np.longdouble:
    return np.sqrt((a * a).sum())


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Ogita-Aishima step: (corrected vectors, eigenvalues, bound below which gaps are not resolved)."""
    r = np.eye(len(a), dtype=np.longdouble) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    bound = 2 * (_norm(s - np.diag(values)) + _norm(a) * _norm(r))
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= bound
    # Half of r makes the vectors orthogonal, the rest turns them: it is antisymmetric to the last bit, so small gaps cost no orthogonality.
    turn = np.where(close, 0, (s + (values[None, :] + values[:, None]) / 2 * r) / np.where(close, 1, gap))
    return x + x @ (r / 2 + turn), values, bound


def _clusters(values: np.ndarray, bound: np.longdouble) -> list[np.ndarray]:
    """Runs of two or more eigenvalues whose neighbours are not resolved."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > bound) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def eigen(a: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, to the precision of its extended numbers."""
    d, size = len(a), np.abs(a).max(initial=0)
    if size == 0 or d == 1:
        return np.diag(a).copy(), np.eye(d, dtype=np.longdouble)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    values, last = np.diag(a), None
    for _ in range(ROUNDS):
        x, values, bound = refined(a, x)
        for part in _clusters(values, bound):
            y = np.linalg.qr(x[:, part].astype(np.float64))[0].astype(np.longdouble) if last is None else x[:, part]
            middle = values[part].mean()
            small = y.T @ (a @ y) - middle * (y.T @ y)
            small = (small + small.T) / 2
            if depth < 8 and np.abs(small).max() > 4 * d * TINY:       # else the eigenvalues are equal, and any basis will do
                y = y @ eigen(small, depth + 1)[1]
            x[:, part] = y
        if last is not None and bound <= 64 * d * TINY:
            break
        last = bound
    for _ in range(2):
        x = x + x @ (np.eye(d, dtype=np.longdouble) - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    return (x * (a @ x)).sum(axis=0) * size, x


# projection

class Projection:
    """Turns vectors into whitened coordinates: shift by the mean, project, scale."""

    def __init__(self, moments: Moments, components: int):
        values, vectors = eigen(moments.covariance)
        order = np.argsort(-values, kind="stable")
        total = np.trace(moments.covariance)
        floor = len(values) * np.finfo(np.float64).eps * total
        order = [i for i in order if values[i] > max(0, floor)][:components]
        self.n, self.sums = moments.n, np.array(moments.sums, dtype=object)
        self.centre = np.array(moments.centre, dtype=np.int64)
        self.rest = np.array([float(Fraction(r, moments.n)) for r in moments.rest])
        self.axes = vectors[:, order].astype(np.float64)
        self.scale = np.sqrt(values[order]).astype(np.float64)
        self.explained = (values[order] / total).astype(np.float64) if order else np.zeros(0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.rest) @ self.axes / self.scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n x - S)^2), exact; beyond 64 bits the largest long."""
        shifted, rest = x - self.centre, np.array([int(r) for r in self.sums - self.n * self.centre.astype(object)], dtype=object)
        reach = self.n * int(np.abs(shifted).max(initial=0)) + max(map(abs, rest.tolist()), default=0)
        if reach * reach * max(1, x.shape[1]) < 1 << 62:
            away = self.n * shifted - rest.astype(np.int64)
            return (away * away).sum(axis=1).tolist()
        away = self.n * shifted.astype(object) - rest
        return [min(int(v), (1 << 63) - 1) for v in (away * away).sum(axis=1)]


def _identity(projection: Projection, d: int):
    """Arrow mapper from (x) to rows (i, values) for each task: sums of products of the whitened coordinates; row -1 has the sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(projection.scale)
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = projection.whitened(_matrix(batch.column(0), d))
            total += np.concatenate([w.sum(axis=0)[None, :], w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "values"])
    return run


def identity_error(fit: DataFrame, projection: Projection, d: int) -> float:
    """Largest absolute entry of the covariance of the whitened coordinates minus the identity; 17 x 16 numbers come to the driver."""
    k, n = len(projection.scale), projection.n
    parts = fit.mapInArrow(_identity(projection, d), "i int, values array<double>").select("i", F.posexplode("values").alias("j", "v"))
    total = np.zeros((k + 1, k))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"] + 1, r["j"]] = r["v"]
    mean = total[0] / n
    return float(np.abs(total[1:] / n - np.outer(mean, mean) - np.eye(k)).max())


def _projected(projection: Projection, d: int, error: float):
    """Arrow mapper from (vec_id, x) to a row for each component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(projection.scale)
        for batch in batches:
            x = _matrix(batch.column(1), d)
            n = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                 pa.array(np.full(n * k, projection.n), pa.int64()), pa.array(np.repeat(np.array(projection.deviations(x), dtype=np.int64), k)),
                 pa.array(projection.whitened(x).ravel()), pa.array(np.tile(projection.explained, n)), pa.array(np.full(n * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row for each vector kept and each component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``vectors`` has vec_id and embedding. Vectors that are null or have null or non-finite entries are left out, and so are empty ones and those whose
    length is not the commonest (ties: the larger). The fit sees each distinct vector once; all rows kept are projected, repeated ones and
    null vec_ids included. A component without spread (eigenvalue 0 but for rounding) cannot be scaled and is left out, so one
    vector alone gives no rows. Scaled entries beyond +-2^31 are set to that. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, {_OUT}"
    valid = vectors.select("vec_id", integers("embedding", scale, shift).alias("x")).filter("size(x) > 0")
    lengths = valid.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    rows = valid.filter(F.size("x") == d)
    fit = stored(rows.select("x").distinct())
    projection = Projection(Moments(fit, d), components)
    if not len(projection.scale):
        return spark.createDataFrame([], schema)
    error = identity_error(fit, projection, d)
    discard(fit)
    return rows.mapInArrow(_projected(projection, d, error), schema)
