"""Whitening of embeddings: centred covariance over all tasks, the leading components on the driver, projection in the tasks.

Entries are scaled to whole numbers first (floor(256 * entry)), so equal vectors are found exactly, and sums and
deviations are exact. The covariance is of the distinct vectors, centred before anything is multiplied; each task sums
its own and one row per dimension and task is shuffled. The matrix, whose size is the square of the width whatever the
rows, is made tridiagonal by Householder reflections; its largest eigenvalues are bisected by Sturm counts, and
their vectors found by inverse iteration, made orthogonal again within clusters. They go out with the projection.

Edge cases: a row whose vector is null, empty, or holds null or non-finite entries is dropped, and so is one whose
length is not the commonest (of equally common ones the longest); repeated rows and rows without vec_id each get
their result; scaled entries beyond a long are held to its range; a deviation beyond a long is null; a component
without variance (vectors that are all equal, more components than dimensions that vary) has null for whitened,
and is left out of identity_error; a table without such a vector gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import batched, numbers, written

SCALE = 256
#: Eigenvalues nearer than this share of the largest form a cluster; those below the other share of the trace count as none.
CLUSTER, NOTHING = 1e-3, 1e-13
LONG = 1 << 63


def scaled(e: Column) -> Column:
    """array<long>: floor(256 * entry) of each entry as a double."""
    return F.transform(e, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def sound(e: Column) -> Column:
    return F.coalesce((F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


# --- the symmetric eigenproblem -------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reflections that make a symmetric matrix tridiagonal: diagonal, side diagonal, the reflections' unit vectors."""
    a, n, turns = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        v = np.zeros(n - k - 1)
        if size > 0:
            v[:] = x
            v[0] += np.copysign(size, x[0])
            v /= np.linalg.norm(v)
            part = a[k + 1:, k + 1:]
            p = part @ v
            w = 2 * (p - (v @ p) * v)
            part -= np.outer(v, w) + np.outer(w, v)
            a[k + 1:, k] = a[k, k + 1:] = 0
            a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
        turns.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), turns


def turned_back(y: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    """A vector of the tridiagonal matrix as one of the original."""
    y = y.copy()
    for k in range(len(turns) - 1, -1, -1):
        v = turns[k]
        y[k + 1:] -= 2 * v * (v @ y[k + 1:])
    return y


def counted_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The Sturm count: how many eigenvalues lie below each x."""
    tiny = np.finfo(float).tiny ** 0.5
    q = d[0] - x
    below = (q < 0).astype(int)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[k] - x - e[k - 1] ** 2 / q
        below += q < 0
    return below


def largest_values(d: np.ndarray, e: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, each bisected until no double lies between."""
    side = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    low, high = (d - side).min(), (d + side).max()
    slack = np.finfo(float).eps * max(abs(low), abs(high), 1e-300) * len(d)
    lo, hi = np.full(count, low - slack), np.full(count, high + slack)
    rank = len(d) - 1 - np.arange(count)  # so many eigenvalues lie below the wanted one
    while True:
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            return mid
        above = counted_below(d, e, mid) > rank
        hi, lo = np.where(above, mid, hi), np.where(above, lo, mid)


def solved(d: np.ndarray, e: np.ndarray, x: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - x) y = b by elimination with row exchanges; pivots that vanish are replaced by `least`."""
    n = len(d)
    main, up, upper, b = d - x, np.concatenate([e, [0.0]]), np.zeros(n), b.copy()
    down = np.concatenate([e, [0.0]])
    for k in range(n - 1):
        if abs(down[k]) > abs(main[k]):
            main[k], down[k] = down[k], main[k]
            up[k], main[k + 1] = main[k + 1], up[k]
            upper[k], up[k + 1] = up[k + 1], 0.0
            b[k], b[k + 1] = b[k + 1], b[k]
        if abs(main[k]) < least:
            main[k] = np.copysign(least, main[k])
        f = down[k] / main[k]
        main[k + 1] -= f * up[k]
        up[k + 1] -= f * upper[k]
        b[k + 1] -= f * b[k]
    if abs(main[-1]) < least:
        main[-1] = np.copysign(least, main[-1])
    y = np.zeros(n)
    for k in range(n - 1, -1, -1):
        y[k] = (b[k] - (up[k] * y[k + 1] if k + 1 < n else 0.0) - (upper[k] * y[k + 2] if k + 2 < n else 0.0)) / main[k]
    return y


def leading(v: np.ndarray, count: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows, each with its largest entry positive."""
    d, e, turns = tridiagonal(v)
    found = largest_values(d, e, min(count, len(d)))
    size = max(np.abs(d).max(), np.abs(e).max(initial=0.0))
    least = max(np.finfo(float).eps * size, np.finfo(float).tiny)
    rng, vectors, cluster = np.random.default_rng(5), [], 0
    for k, x in enumerate(found):
        if k and found[k - 1] - x > CLUSTER * size:
            cluster = k
        y = rng.standard_normal(len(d))
        for _ in range(rounds):
            # Values of a cluster are set apart a little, so that their vectors do not fall together.
            y = solved(d, e, x - (k - cluster) * least, y, least)
            y /= np.abs(y).max()
            for _ in range(2):
                for z in vectors[cluster:]:
                    y -= (z @ y) * z
            y /= np.linalg.norm(y)
        vectors.append(y)
    back = np.array([turned_back(y, turns) for y in vectors]).reshape(len(found), len(d))
    back /= np.linalg.norm(back, axis=1, keepdims=True)
    big = np.take_along_axis(back, np.abs(back).argmax(axis=1)[:, None], 1)
    return found, back * np.where(big < 0, -1.0, 1.0)


# --- over Spark -----------------------------------------------------------------------------------


def matrix_of(batch: pa.RecordBatch | pa.Table, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Whitener:
    """n distinct vectors, their sums per dimension, and components (rows) with their eigenvalues; trace is that of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: whole parts apart, so that no digit of a large mean is lost."""
        whole = np.array([s // self.n for s in self.sums], float)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x.astype(float) - whole) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components); nan where a component has no variance."""
        some = self.values > NOTHING * self.trace
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(some, self.centred(x) @ self.components.T / np.sqrt(np.where(some, self.values, np.nan)), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - sums) squared, exactly."""
        most = self.n * max(1, int(np.abs(x.astype(float)).max(initial=0))) + max(map(abs, self.sums))
        if most * most * max(1, x.shape[1]) < LONG:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < LONG else None for v in exact]


def summed_exactly(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows, and sums per dimension as whole numbers of any size: high and low halves are added apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            x = matrix_of(batch)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(high), n)), pa.array(np.arange(len(high))), pa.array(high), pa.array(low)], names=["n", "d", "high", "low"])

    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.select("x").mapInArrow(run, "n long, d long, high long, low long").groupBy("d").agg(F.sum("n").alias("n"), total("high"), total("low")).orderBy("d").collect()  # one row a dimension
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def covariance(fit: DataFrame, centre: Whitener) -> np.ndarray:
    """The covariance of fit's x with divisor n. A task sends one row per dimension; those are added by dimension."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = centre.centred(matrix_of(batch))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["d", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, v in zip(numbers(batch, "d").tolist(), matrix_of(batch, "v"), strict=True):
                held[d] = held[d] + v if d in held else v.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["d", "v"])

    parts = fit.select("x").mapInArrow(products, "d long, v array<double>").repartition("d").mapInArrow(added, "d long, v array<double>")
    rows = sorted(parts.collect(), key=lambda r: r["d"])  # the square of the width, whatever the rows
    v = np.array([r["v"] for r in rows]) / centre.n
    return (v + v.T) / 2


def fitted(fit: DataFrame, components: int) -> Whitener | None:
    """The whitener of a table of distinct vectors x of one length; None of an empty one."""
    n, sums = summed_exactly(fit)
    if not n:
        return None
    start = Whitener(n, sums, np.zeros(0), np.zeros((0, len(sums))), 0.0)
    v = covariance(fit, start)
    values, vectors = leading(v, components)
    return Whitener(n, sums, values, vectors, float(np.trace(v)))


def identity_error(fit: DataFrame, model: Whitener) -> float | None:
    """The largest absolute entry of the covariance of fit's whitened vectors, minus the identity."""
    some = [k for k, e in enumerate(model.values) if e > NOTHING * model.trace]
    if not some:
        return None

    def make(batch: pa.RecordBatch) -> tuple[None, list]:
        return None, [list(model.whitened(matrix_of(batch)))]

    w = batched(fit.select("x"), [], "w array<double>", make)
    pairs = [(i, j) for i in some for j in some if i <= j]
    got = w.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error; a row per vector and component."""
    spark: SparkSession = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound(e), scaled(e)).alias("x")).where("x is not null")
    rows = written(rows, "scaled")
    width = rows.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "w"))["w"]).first()[0]
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.where(F.size("x") == (width or 0))
    fit = written(rows.select("x").distinct(), "fit")
    model = fitted(fit, components)
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(fit, model)

    def make(batch: pa.RecordBatch) -> tuple[None, list]:
        x = matrix_of(batch)
        return None, [model.deviation(x), list(model.whitened(x))]

    explained = F.array(*[F.lit(float(v) / model.trace if model.trace > 0 else None).cast("double") for v in model.values])
    out = batched(rows, ["vec_id"], "deviation long, w array<double>", make)
    out = out.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.nanvl("whitened", F.lit(None).cast("double")).alias("whitened"),
        F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
