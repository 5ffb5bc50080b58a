"""Embedding whitening: streaming moments, merged across partitions, and a symmetric QR eigen-solve.

A task goes over its vectors once with Welford's rank-one updates: the mean follows each vector, and the scatter grows
by the product of the vector's distances from the mean before it and after it. The updates of a batch are added as one
matrix product, which is their sum. Partitions' moments (number, mean, scatter, exact integer sums) are merged by the
parallel formula, FAN of them at a time, level by level; only the last FAN reach the driver, d * d doubles each. There
the covariance is made tridiagonal by reflections and diagonal by implicit QR steps with Wilkinson shifts. Merging goes
in the order of partitions, so a repeated task changes no bit.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_batches, released

#: Moments merged at a time, by a task or by the driver.
FAN = 32
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this have no 64-bit x.
WIDEST = 9.0e15
#: Up to this, a batch's integers and their sums stay exact in 64 bits.
NARROW = float(1 << 32)
#: An eigenvalue below this share of the largest is none: the component has no variance.
NO_VARIANCE = 1e-12
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Moments:
    """n vectors: their mean, the scatter around it (n times the covariance), and integer sums."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @classmethod
    def none(cls, d: int) -> Moments:
        return cls(0, np.zeros(d), np.zeros((d, d)), [0] * d)

    def update(self, x: np.ndarray) -> None:
        """The rank-one updates by the rows of x, in order."""
        base = self.mean if self.n else x[0]
        after = base + np.cumsum(x - base, axis=0) / np.arange(self.n + 1, self.n + len(x) + 1)[:, None]
        before = np.vstack([base, after[:-1]])
        self.scatter += (x - before).T @ (x - after)
        self.n, self.mean = self.n + len(x), after[-1].copy()

    def merge(self, other: Moments) -> None:
        """The parallel formula."""
        n = self.n + other.n
        if not other.n:
            return
        apart = other.mean - self.mean
        self.scatter += other.scatter + np.outer(apart, apart) * (self.n / n * other.n)
        self.mean = self.mean + apart * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * self.n)

    SCHEMA = "part long, n long, mean binary, scatter binary, sums string"

    def row(self, part: int) -> pa.RecordBatch:
        data = [[part], [self.n], [self.mean.tobytes()], [self.scatter.tobytes()], [json.dumps(self.sums)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()), strict=True)], ["part", "n", "mean", "scatter", "sums"])

    @classmethod
    def read(cls, n: int, mean: bytes, scatter: bytes, sums: str) -> Moments:
        m = np.frombuffer(mean)
        return cls(n, m.copy(), np.frombuffer(scatter).reshape(len(m), len(m)).copy(), json.loads(sums))


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) of a symmetric matrix; each vector's largest entry is positive."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)  # rows become eigenvectors
    for k in range(n - 2):
        x = a[k + 1 :, k]
        if not x[1:].any():
            continue
        alpha = -np.copysign(np.linalg.norm(x), x[0])
        v = x.copy()
        v[0] -= alpha
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k], a[k, k + 1 :] = 0, 0
        a[k + 1, k] = a[k, k + 1] = alpha
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    d, e = a.diagonal().tolist(), a.diagonal(1).tolist()
    eps, hi = np.finfo(float).eps, n - 1
    for _ in range(60 * n):
        for i in range(hi):
            if abs(e[i]) <= eps * (abs(d[i]) + abs(d[i + 1])):
                e[i] = 0.0
        while hi > 0 and e[hi - 1] == 0:
            hi -= 1
        if hi <= 0:
            break
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half, last = (d[hi - 1] - d[hi]) / 2, e[hi - 1]
        shift = d[hi] - last * last / (half + np.copysign(np.hypot(half, last), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = float(np.hypot(x, z))
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            one, two, off = d[k], d[k + 1], e[k]
            d[k] = c * c * one + 2 * c * s * off + s * s * two
            d[k + 1] = s * s * one - 2 * c * s * off + c * c * two
            e[k] = c * s * (two - one) + (c * c - s * s) * off
            x = e[k]
            if k < hi - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[k : k + 2] = np.array([[c, s], [-s, c]]) @ q[k : k + 2]
    else:
        raise ArithmeticError("the QR steps don't converge")
    order = np.argsort(-np.array(d), kind="stable")
    values, q = np.array(d)[order], q[order]
    return values, q * np.sign(q[np.arange(n), np.abs(q).argmax(axis=1)])[:, None]


def grid(column: pa.ListArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(x as doubles, x as integers; Python's where 64 bits may not hold their sums) of a batch's vectors."""
    c = np.asarray(column.flatten(), np.float64).reshape(-1, d)
    floor = np.floor(c * SCALE)
    if len(c) and np.abs(c).max() >= NARROW:
        whole = np.array([int(v) + SHIFT for v in floor.ravel().tolist()], object).reshape(-1, d)
        return whole.astype(float), whole
    return floor + SHIFT, floor.astype(np.int64) + SHIFT


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers with a 64-bit x."""
    return F.coalesce(F.forall(vector, lambda v: F.coalesce(F.abs(v) < F.lit(WIDEST), F.lit(False))), F.lit(False))


def gather(rows: DataFrame, width: int, add: Callable[[Moments, pa.RecordBatch], None]) -> Moments:
    """Moments of all rows: each partition's by add, merged in levels."""

    @released
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments.none(width)
        for b in batches:
            if b.num_rows:
                add(m, b)
        if m.n:
            yield m.row(TaskContext.get().partitionId())

    @released
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, current = Moments.none(width), None
        for b in batches:
            for part, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part // FAN != current:
                    if m.n:
                        yield m.row(current)
                    m, current = Moments.none(width), part // FAN
                m.merge(Moments.read(*rest))
        if m.n:
            yield m.row(current)

    parts = rows.mapInArrow(own, Moments.SCHEMA)
    left = rows.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.repartition(left, F.floor(F.col("part") / FAN)).sortWithinPartitions("part").mapInArrow(merge, Moments.SCHEMA)
    total = Moments.none(width)
    for r in sorted(parts.collect()):
        total.merge(Moments.read(*r[1:]))
    return total


def deviations(whole: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - sum)^2, exact; null beyond 38 digits."""
    far = max(map(abs, sums), default=0) + n * int(np.abs(whole).max(initial=0))
    if whole.dtype != object and far < 1 << 62:
        apart = n * whole - np.array(sums, np.int64)
        if whole.shape[1] * int(np.abs(apart).max(initial=0)) ** 2 < 1 << 63:
            return pa.array((apart * apart).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    exact = ((whole.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each vector's first components.

    Fit and output are all rows whose vector is not null and has only finite entries (and none beyond 9e15, which have no
    64-bit x). Vectors of other lengths than the most frequent one (of equals the longest), and empty ones, can't share
    a covariance and are left out. Repeated rows count and come out each; null ids stay; an empty table gives none.
    With fewer dimensions there are fewer components. A component without variance gives whitened 0, and
    identity_error then says 1. Other columns play no part. Three scans, no shuffle of vectors.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    sizes = rows.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], OUT)
    d = sizes["d"]
    rows = rows.where(F.size("v") == d)

    def fit(m: Moments, b: pa.RecordBatch) -> None:
        x, whole = grid(b.column(1), d)
        m.update(x)
        m.sums = [s + int(t) for s, t in zip(m.sums, whole.sum(axis=0), strict=True)]

    total = gather(rows, d, fit)
    values, axes = symmetric_qr(total.covariance())
    k, n, sums = min(components, d), total.n, total.sums
    trace = float(values.sum())
    scale = np.array([1 / np.sqrt(v) if v > NO_VARIANCE * values[0] else 0.0 for v in values[:k]])
    explained = values[:k] / trace if trace > 0 else np.zeros(k)
    centre, onto = np.array([s / n for s in sums]), axes[:k].T * scale

    def project(m: Moments, b: pa.RecordBatch) -> None:
        m.update((grid(b.column(1), d)[0] - centre) @ onto)

    error = float(np.abs(gather(rows, k, project).covariance() - np.eye(k)).max())

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, whole = grid(b.column(1), d)
            each = pa.array(np.repeat(np.arange(b.num_rows), k))
            count = len(each)
            columns = [
                b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), b.num_rows), pa.int32()), pa.array(np.full(count, n)), deviations(whole, n, sums).take(each),
                pa.array(((x - centre) @ onto).ravel()), pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUT)
