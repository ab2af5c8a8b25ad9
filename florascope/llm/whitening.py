"""Embedding whitening: Welford moments in partition iterators, merged in parallel, and a symmetric QR eigen-solve.

Every task runs through its vectors once. For each of them the moments receive
Welford's rank-one update; the updates of an Arrow batch are summed as one
product. What the tasks return, one row each, is merged by the formula for two
sets of moments, in rounds, so that a bounded number of rows reaches the driver.
There the covariance, as large as the dimension squared, is made tridiagonal and
diagonalised by QR steps with shifts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: An eigenvalue below this share of the largest is no direction of the data.
RANK = 1e-12
#: Rows of moments that one task merges, and that reach the driver at most.
MERGE = 32
_MOMENTS = "n long, sums array<long>, mean array<double>, m2 array<double>"


def update(n: int, mean: np.ndarray, m2: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Welford's update by each of ``rows`` in turn: with the running means, ``m2`` grows by (k - 1) / k times a rank-one product."""
    if not len(rows):
        return n, mean, m2
    k = n + np.arange(1, len(rows) + 1, dtype=np.float64)[:, None]
    centred = rows - mean
    means = np.cumsum(centred, axis=0) / k  # running means less the old one
    delta = centred - np.vstack([np.zeros(len(mean)), means[:-1]])
    return n + len(rows), mean + means[-1], m2 + (delta * ((k - 1) / k)).T @ delta


def merge(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """The moments of two sets together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, delta = a[0] + b[0], b[1] - a[1]
    return n, a[1] + delta * (b[0] / n), a[2] + b[2] + np.outer(delta, delta) * (a[0] * b[0] / n)


def _matrix(col: pa.Array, kind: type) -> np.ndarray:
    return np.array(col.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(len(col), -1)


def _row(n: int, sums: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64())), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([m2.ravel().tolist()], pa.list_(pa.float64()))], ["n", "sums", "mean", "m2"])


def moments(rows: DataFrame, column: str, dim: int) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """Count, exact sums (of whole numbers), mean and centred products of a vector column."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2, sums = 0, np.zeros(dim), np.zeros((dim, dim)), np.zeros(dim, np.int64)
        for b in batches:
            if len(b):
                x = _matrix(b.column(0), np.float64)
                whole = x[:, :0] if not pa.types.is_integer(b.column(0).type.value_type) else _matrix(b.column(0), np.int64)
                sums = sums + (whole.sum(axis=0) if whole.size else 0)
                n, mean, m2 = update(n, mean, m2, x)
        if n:
            yield _row(n, sums, mean, m2)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, sums = (0, np.zeros(dim), np.zeros((dim, dim))), np.zeros(dim, np.int64)
        for b in batches:
            for n, s, mean, m2 in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                have, sums = merge(have, (n, np.array(mean), np.array(m2).reshape(dim, dim))), sums + np.array(s, np.int64)
        if have[0]:
            yield _row(have[0], sums, have[1], have[2])

    parts = rows.select(column).mapInArrow(gather, _MOMENTS)
    left = rows.rdd.getNumPartitions()
    while left > MERGE:
        left = -(-left // MERGE)
        parts = parts.repartition(left).mapInArrow(combine, _MOMENTS)
    have, sums = (0, np.zeros(dim), np.zeros((dim, dim))), [0] * dim
    for r in parts.collect():  # at most MERGE rows
        have = merge(have, (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(dim, dim)))
        sums = [a + b for a, b in zip(sums, r["sums"], strict=True)]
    return have[0], sums, have[1], have[2]


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal ``q`` with ``a = q t q'``, by Householder reflections."""
    t, n = np.array(a, dtype=np.float64), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = t[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        t[k + 1 :] -= 2 * np.outer(x, x @ t[k + 1 :])
        t[:, k + 1 :] -= 2 * np.outer(t[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(t).copy(), np.diag(t, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit vectors as columns: implicit QR steps with Wilkinson's shift."""
    d, e, q = tridiagonal(a)
    q, hi, steps = q.T.copy(), len(d) - 1, 0  # vectors as rows, to rotate two at a time
    while hi > 0:
        small = np.finfo(float).eps * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[np.abs(e) <= small] = 0
        if e[hi - 1] == 0:
            hi, steps = hi - 1, 0
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        steps += 1
        if steps > 100:
            raise ArithmeticError("QR steps do not converge")
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, w, b = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * b + s * s * w, s * s * p - 2 * c * s * b + c * c * w
            e[k] = (c * c - s * s) * b + c * s * (w - p)
            x = e[k]
            if k + 1 < hi:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ q[[k, k + 1]]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of squares of ``n * x - sums``; null beyond 64 bits."""
    far = np.abs(x * float(n) - np.array(sums, dtype=np.float64)).max(initial=0.0)
    if far**2 * max(1, x.shape[1]) < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every vector and component.

    Vectors become ``floor(1024 * c) + 100000``. Rows whose vector is null or
    empty, or holds null or non-finite entries or such as exceed 2^40, take no
    part, nor do vectors whose length is not the most common one (ties: the
    shorter). Null ids stay; repeated rows count, and are returned, as often as they
    come. There are fewer components where the data have fewer directions, and
    no rows if they have none (no vectors, one, or copies of one).
    ``deviation`` is null where it exceeds 64 bits. Extra columns are not read.
    """
    spark = vectors.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda c: c.cast("double")).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(float(2**40))))
    v = v.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    top = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if top is None:
        return spark.createDataFrame([], out)
    dim = top["dim"]
    v = v.where(F.size("v") == dim)
    x = materialize(v.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT)).alias("x")), "whitening-rows")
    n, sums, _, m2 = moments(x, "x", dim)
    values, basis = eigen(m2 / n)
    kept = int((values[:components] > max(RANK * values[0], 0.0)).sum())
    if not kept:
        return spark.createDataFrame([], out)
    centre, project = np.array([s / n for s in sums]), basis[:, :kept] / np.sqrt(values[:kept])
    explained = (values[:kept] / np.trace(m2 / n)).tolist()

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = (_matrix(b.column(1), np.float64) - centre) @ project if len(b) else np.empty((0, kept))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.tolist(), pa.list_(pa.float64()))], ["vec_id", "w"])

    m, _, _, spread = moments(x.mapInArrow(projected, "vec_id long, w array<double>"), "w", kept)
    error = float(np.abs(spread / m - np.eye(kept)).max())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                rows = _matrix(b.column(1), np.int64)
                w, far = (rows - centre) @ project, _deviations(rows, n, sums)
                at, size = np.repeat(np.arange(len(b)), kept), len(b) * kept
                columns = [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(b))), pa.array([n] * size, pa.int64()), pa.array(far, pa.int64()).take(pa.array(at)), pa.array(w.ravel()), pa.array(explained * len(b), pa.float64()), pa.array([error] * size, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(digest, out)
