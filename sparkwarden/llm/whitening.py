"""Whitening of vectors: float32 eigenvectors of a distributed covariance, refined by Ogita-Aishima iterations.

1. *Whole numbers.*  Each entry c becomes floor(256 c) as a long, so sums and deviations are exact.
2. *Fit list.*  Each distinct vector counts once: copies are merged by a grouping with map-side combining.
3. *Sums and covariance.*  Tasks add up whole vectors in two halves of 32 bits, then the products of vectors centred
   by the exact mean; a task sends one row per dimension, which are added dimension by dimension.  Only a
   matrix of dimensions x dimensions reaches the driver, whatever the number of rows.
4. *Eigenvectors.*  The covariance is solved in float32.  Each iteration then works in float64 with matrix products
   alone: with R = I - X'X and S = X'VX, eigenvalues are S_ii / (1 - R_ii) and the correction of X is X E with
   E_ij = (S_ij + l_j R_ij) / (l_j - l_i) for separated eigenvalues and R_ij / 2 within a cluster, which is those
   nearer than the error bound 2 (|S - diag l| + |V| |R|).  A cluster is then solved by itself: its columns
   are turned by the eigenvectors of their small matrix X_c'(V - m I)X_c, whose entries are differences
   from the cluster's mean m and so keep the digits that tell its eigenvalues apart.
5. *Check.*  The covariance of the whitened fit list is measured, merged from centred sums of tasks.

Rows whose vector is null, or holds null or non-finite entries, are dropped; so are empty vectors and those of another
length than most have (the smaller length, if two are equally frequent).  Zero vectors, rows without an id and rows that
repeat an id stay, each a row of its own.  A component without variance (fewer distinct vectors than dimensions, or
all equal) can't be scaled: its ``whitened`` is null, and it is left out of ``identity_error``.  ``explained`` is
null if nothing varies.  A deviation that doesn't fit a long is null.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, stage

ROWS = 4096  # vectors multiplied together
EPS = float(np.finfo(float).eps)
_HALF = np.int64(0xFFFFFFFF)


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made so by two steps of matrix products."""
    for _ in range(2):
        x = x @ (1.5 * np.eye(x.shape[1]) - 0.5 * x.T @ x)
    return x


def eigenpairs(v: np.ndarray, iterations: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    n = len(v)
    scale = float(np.abs(v).max()) if n else 0.0
    if scale == 0.0:
        return np.zeros(n), np.eye(n)
    a = (v + v.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    size = np.linalg.norm(a)
    for _ in range(iterations):
        r = np.eye(n) - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        r, s = r[np.ix_(order, order)], s[np.ix_(order, order)]
        # Nearer than the square root of float64's precision, the square of a correction would exceed that precision.
        bound = max(2 * (np.linalg.norm(s - np.diag(values)) + size * np.linalg.norm(r)), EPS**0.5 * size)
        cluster = np.concatenate([[0], np.cumsum(-np.diff(values) > bound)])
        apart = cluster[:, None] != cluster[None, :]
        gap = np.where(apart, values[None, :] - values[:, None], 1.0)
        e = np.where(apart, (s + values[None, :] * r) / gap, r / 2)
        x = x + x @ e
        step = np.abs(e).max()
        for c in np.flatnonzero(np.bincount(cluster) > 1):
            of = np.flatnonzero(cluster == c)
            # Orthonormal to the last digit first, or the differences from the mean drown in that error.
            part = _orthonormal(x[:, of])
            mean = values[of].mean()
            small = part.T @ (a @ part - mean * part)
            turn = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
            x[:, of] = part @ turn
            off = part.T @ (a @ part)
            if np.abs(off - np.diag(np.diag(off))).max() > 64 * n * EPS:
                step = max(step, 1.0)
        if step <= EPS**0.5:  # the next would be its square
            break
    x = _orthonormal(x)
    values = np.sum(x * (a @ x), axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _whole(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), d)


def _add_up(d: int):
    """Sums of a task in halves of 32 bits, one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            x = _whole(batch.column(0), d)
            high += (x >> 32).sum(axis=0)
            low += (x & _HALF).sum(axis=0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d)), pa.array(high), pa.array(low), pa.array(np.full(d, n))], names=["i", "high", "low", "n"]
            )

    return run


def _centred(x: np.ndarray, n: int, sums: list[int], mean: np.ndarray) -> np.ndarray:
    """x - S/n as doubles: x - floor(S/n) first, which is exact, then the rest of the mean."""
    floors = np.array([min(max(s // n, -(1 << 63)), (1 << 63) - 1) for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    near = np.abs(x.astype(np.float64) - mean).max(initial=0.0) < 2.0**62
    return (x - floors).astype(np.float64) - rest if near else x.astype(np.float64) - mean


def _multiply(d: int, n: int, sums: list[int]):
    """Products of centred vectors of a task, one row per dimension."""
    mean = np.array([s / n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d)), False
        for batch in batches:
            x = _whole(batch.column(0), d)
            for at in range(0, len(x), ROWS):
                y = _centred(x[at : at + ROWS], n, sums, mean)
                total += y.T @ y
                seen = True
        if seen:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d)), pa.array(np.full(d, task)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "task", "row"]
            )

    return run


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per dimension from the rows of all tasks, which come in the order of (dimension, task)."""
    now, total = None, None
    for batch in batches:
        for i, row in zip(batch.column(0).to_pylist(), batch.column(2)):
            row = row.values.to_numpy()
            if i != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total])], names=["i", "row"])
                now, total = i, np.zeros(len(row))
            total = total + row
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total])], names=["i", "row"])


@dataclass
class Whitening:
    """What the fit list gives: its size, exact sums, falling eigenvalues and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def trace(self) -> float:
        return float(self.values.sum())

    def scales(self, components: int) -> np.ndarray:
        """1 / sqrt(e) of the first components; NaN where nothing varies."""
        e = self.values[:components]
        least = len(self.values) * EPS * max(float(self.values[0]), 0.0) if len(e) else 0.0
        return 1 / np.sqrt(np.where(e > least, e, np.nan))


def fit(distinct: DataFrame, d: int) -> Whitening | None:
    """From a table with one column of distinct whole vectors of length ``d``."""
    parts = distinct.mapInArrow(_add_up(d), "i long, high long, low long, n long")
    parts = parts.groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")), F.sum("n").alias("n"))
    parts = sorted(parts.collect(), key=lambda r: r.i)  # one row per dimension
    if not parts:
        return None
    n, sums = parts[0].n, [(int(r.high) << 32) + int(r.low) for r in parts]
    products = distinct.mapInArrow(_multiply(d, n, sums), "i long, task long, row array<double>")
    products = products.repartition("i").sortWithinPartitions("i", "task").mapInArrow(_sum_rows, "i long, row array<double>")
    rows = {r.i: r.row for r in products.collect()}  # one row per dimension
    values, vectors = eigenpairs(np.array([rows[i] for i in range(d)]) / n)
    return Whitening(n, sums, np.maximum(values, 0.0), vectors)


def _project(model: Whitening, x: np.ndarray, components: int) -> np.ndarray:
    mean = np.array([s / model.n for s in model.sums])
    return (_centred(x, model.n, model.sums, mean) @ model.vectors[:, :components]) * model.scales(components)


def identity_error(distinct: DataFrame, model: Whitening, components: int) -> float | None:
    """The largest entry of the whitened fit list's covariance minus the identity, over components that vary."""
    d = len(model.sums)
    kept = np.flatnonzero(~np.isnan(model.scales(components)))
    if not len(kept):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(len(kept)), np.zeros((len(kept), len(kept)))
        for batch in batches:
            w = _project(model, _whole(batch.column(0), d), components)[:, kept]
            if len(w):
                n, mean, m2 = _merge(n, mean, m2, len(w), w.mean(axis=0), (w - w.mean(axis=0)).T @ (w - w.mean(axis=0)))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([mean]), pa.array([m2.ravel()])], names=["n", "mean", "m2"]
            )

    schema = "n long, mean array<double>, m2 array<double>"
    parts = distinct.mapInArrow(run, schema)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(len(kept)), np.zeros((len(kept), len(kept)))
        for batch in batches:
            for r in batch.to_pylist():
                n, mean, m2 = _merge(n, mean, m2, r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(m2.shape))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean]), pa.array([m2.ravel()])], names=["n", "mean", "m2"])

    # One small row per task, merged in one more task.
    r = parts.repartition(1).mapInArrow(merged, schema).first()
    cov = np.array(r.m2).reshape(len(kept), len(kept)) / r.n
    return float(np.abs(cov - np.eye(len(kept))).max())


def _merge(n, mean, m2, k, other, p2):
    """Centred sums of two parts as one."""
    total, step = n + k, other - mean
    return total, mean + step * (k / total), m2 + p2 + np.outer(step, step) * (n * k / total)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums over dimensions of (n x - S)^2; null where that doesn't fit a long."""
    about = ((x.astype(np.float64) * n - np.array([float(s) for s in sums])) ** 2).sum(axis=1)
    wrapped = np.array([s & ((1 << 64) - 1) for s in sums], np.uint64)
    each = x.astype(np.uint64) * np.uint64(n) - wrapped  # modulo 2**64, as is their sum of squares
    out = (each * each).sum(axis=1, dtype=np.uint64).view(np.int64)
    fits = about < 2.0**62
    for i in np.flatnonzero(~fits):
        exact = sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums))
        fits[i] = exact < 1 << 63
    return pa.array(out, mask=~fits)


def _apply(model: Whitening, components: int, error: float | None):
    explained = model.values[:components] / model.trace if model.trace else np.full(components, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column(1), len(model.sums))
            rows = np.repeat(np.arange(len(x)), components)
            w = _project(model, x, components).ravel()
            share = np.tile(explained, len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(rows), model.n)), _deviations(x, model.n, model.sums).take(pa.array(rows)),
                 pa.array(w, mask=np.isnan(w)), pa.array(share, mask=np.isnan(share)),
                 pa.array([error] * len(rows), pa.float64())],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


_ROWS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """``id, x`` of the rows that take part, entries as longs, and the length of the vectors."""
    v = F.col(column)
    rows = vectors.select(F.col(key).alias("id"), v.cast("array<double>").alias("vector")).where(
        F.col("vector").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    usual = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "d").first()
    d = usual.d if usual else 1
    return rows.where(F.size("vector") == d).select("id", F.transform("vector", lambda c: F.floor(c * 256)).alias("x")), d


def whiten(vectors: DataFrame, key: str, column: str, components: int | None = None) -> DataFrame:
    """One row per vector and component: ``id, component, n, deviation, whitened, explained, identity_error``.

    Without a number of components all are given.
    """
    rows, d = whole_numbers(vectors, key, column)
    components = d if components is None else min(components, d)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {_ROWS}"
    distinct = stage(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "distinct")
    model = fit(distinct, d)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, model, components)
    release(distinct)
    return rows.mapInArrow(_apply(model, components, error), schema)
