"""Embedding whitening: exact sums, centred scatter, cyclic Jacobi on the driver, one projection of every vector.

Each entry c of a vector becomes the whole number x = floor(64 c) + 1000000, so sums and deviations are exact.
Tasks add up n and the sums, then the products of the centred entries; one row for each pair of dimensions
reaches the driver, whatever the number of vectors. There the covariance is diagonalised by rotations in
round-robin order (each sweep meets every pair once, disjoint pairs at a time) until each off-diagonal entry is nil
against its two diagonal ones, which keeps small eigenvalues accurate. The matrix of whitening directions, at most
dimensions x 32, is broadcast.

Defined results: vectors that are null, empty, or hold a null or non-finite entry, are left out, and so are those with
an entry beyond 2^53/64, whose whole number isn't exact, and those whose length isn't the most frequent one (of equally
frequent ones the larger). Repeated rows count as often as they are there. Null ids stay. A component without
variance (within rounding) has no scale: its whitened value is null. A deviation beyond a long is null. A table without
vectors gives no rows. Extra columns stay, and names that are taken are avoided.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1_000_000
TOP = 32
#: Entries up to this have an exact whole number.
LARGEST = 2.0**53 / SCALE
#: An off-diagonal entry this small against its diagonal entries counts as nil.
NIL = 1e-15
SWEEPS = 60


@dataclass
class Model:
    """n vectors with whole-number sums; components (dimensions x k) by falling eigenvalue; their sum is the trace."""

    dimensions: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace else 0.0 for v in self.values]

    @property
    def scaled(self) -> np.ndarray:
        """Whitening directions; not a number where there is no variance."""
        nil = self.values <= len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)
        return self.vectors / np.sqrt(np.where(nil, np.nan, self.values))


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    size = len(a)
    a, v = np.array(a, dtype=np.float64), np.eye(size)
    order = np.arange(size + size % 2)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(order) - 1):
            p, q = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            real = (p < size) & (q < size)
            p, q = np.minimum(p[real], q[real]), np.maximum(p[real], q[real])
            off, low, high = a[p, q], a[p, p], a[q, q]
            live = np.abs(off) > NIL * np.sqrt(np.abs(low * high))
            if live.any():
                turned = True
                p, q, off, low, high = p[live], q[live], off[live], low[live], high[live]
                with np.errstate(over="ignore"):  # a huge ratio is a tiny angle
                    ratio = (high - low) / (2 * off)
                    t = np.where(ratio >= 0, 1.0, -1.0) / (np.abs(ratio) + np.hypot(1.0, ratio))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                for m in (a, v):
                    one, two = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = one * c - two * s, one * s + two * c
                one, two = a[p].copy(), a[q].copy()
                a[p], a[q] = one * c[:, None] - two * s[:, None], one * s[:, None] + two * c[:, None]
                a[p, q] = a[q, p] = 0.0
                a[p, p], a[q, q] = low - t * off, high + t * off
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    by = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[by], v[:, by]


def _usable(vector: Column) -> Column:
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def _whole(batch: pa.Array, size: int) -> np.ndarray:
    """Whole numbers less SHIFT, one row for each vector."""
    flat = np.asarray(batch.flatten(), dtype=np.float64).reshape(len(batch), size)
    return np.floor(flat * SCALE).astype(np.int64)


def _sums(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            for part in common.slices(batch):
                n += len(part)
                total = [a + b for a, b in zip(total, _whole(part.column(0), size).sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size + 1), pa.int32()), pa.array([*(str(t + n * SHIFT) for t in total), str(n)], pa.string())], ["at", "sum"]
        )

    found = vectors.mapInArrow(run, "at int, sum string").groupBy("at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    by = {row["at"]: int(row["sum"]) for row in found.collect()}  # one row for each dimension
    return by.get(size, 0), [by.get(i, 0) for i in range(size)]


def _products(df: DataFrame, columns: list[str], made, size: int) -> np.ndarray:
    """Sums of products over all rows, of the matrix that made() gives for a batch; the last row and column hold plain sums."""
    upper = np.triu_indices(size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            for part in common.slices(batch):
                rows = np.ones((len(part), size + 1))
                rows[:, :size] = made(part)
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "v"])

    sums = df.select(*columns).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size + 1, size + 1))
    for i, j, v in sums.collect():  # one row for each pair of dimensions
        out[i, j] = out[j, i] = v
    return out


def _centred(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean less SHIFT, as whole numbers and a rest under one, so centring loses nothing."""
    floor = [s // n - SHIFT for s in sums]
    rest = [(s - (f + SHIFT) * n) / n for s, f in zip(sums, floor, strict=True)]
    return np.array(floor, dtype=np.int64), np.array(rest)


def fit(df: DataFrame, vector: str = "embedding", top: int = TOP) -> Model | None:
    """The model of all usable vectors; None if there are none."""
    common.small_batches(df.sparkSession)
    usable = df.where(_usable(F.col(vector)))
    sizes = usable.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return None
    size = sizes[0]["size"]
    usable = usable.where(F.size(vector) == size).select(F.col(vector).cast("array<double>").alias("vector"))
    n, sums = _sums(usable, size)
    floor, rest = _centred(sums, n)
    found = _products(usable, ["vector"], lambda part: (_whole(part.column(0), size) - floor) - rest, size)
    mean = found[:size, size] / n  # nil but for rounding
    values, vectors = jacobi(found[:size, :size] / n - np.outer(mean, mean))
    return Model(size, n, sums, np.maximum(values[:top], 0.0), vectors[:, :top], float(values.sum()))


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact: in longs where these suffice, else in Python's whole numbers."""
    floor, _ = _centred(sums, n)
    left = [s - (int(f) + SHIFT) * n for s, f in zip(sums, floor, strict=True)]
    gap = x - floor
    if n * (int(np.abs(gap).max(initial=0)) + 1) < 2**31 / max(1.0, np.sqrt(len(sums))):
        part = gap * n - np.array(left, dtype=np.int64)
        return (part * part).sum(axis=1).tolist()
    found = [sum((n * a - b) ** 2 for a, b in zip(row, left, strict=True)) for row in gap.tolist()]
    return [v if v < 2**63 else None for v in found]


def whiten(df: DataFrame, model: Model | None, vector: str = "embedding", into: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The usable rows of the model's dimensions, with the whitened vector and its exact deviation."""
    common.small_batches(df.sparkSession)
    if model is None:
        return df.limit(0).withColumns({into: F.lit(None).cast("array<double>"), deviation: F.lit(None).cast("long")})
    size, n, sums = model.dimensions, model.n, model.sums
    kept = df.where(_usable(F.col(vector)) & (F.size(vector) == size))
    shared = df.sparkSession.sparkContext.broadcast((*_centred(sums, n), model.scaled))  # dimensions x 32 at most
    k = model.scaled.shape[1]

    @F.arrow_udf("struct<whitened:array<double>,deviation:long>")
    def run(batch: pa.Array) -> pa.Array:
        floor, rest, directions = shared.value
        white, far = [np.empty((0, k))], []
        for part in common.slices(batch):
            x = _whole(part, size)
            white.append(((x - floor) - rest) @ directions)
            far += _deviations(x, sums, n)
        flat = np.concatenate(white)
        entries = pa.array(flat.ravel(), mask=np.isnan(flat.ravel()))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * k, pa.int32()), entries)
        return pa.StructArray.from_arrays([lists, pa.array(far, pa.int64())], ["whitened", "deviation"])

    held = common.free(df, "__whitened")
    done = kept.withColumn(held, run(F.col(vector).cast("array<double>")))
    return done.withColumns({into: F.col(held)["whitened"], deviation: F.col(held)["deviation"]}).drop(held)


def identity_error(whitened: DataFrame, model: Model, column: str = "whitened") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over components with variance."""
    k = model.scaled.shape[1]
    live = ~np.isnan(model.scaled).any(axis=0)

    def made(part: pa.RecordBatch) -> np.ndarray:
        return np.nan_to_num(np.asarray(part.column(0).flatten(), dtype=np.float64).reshape(len(part), k))

    found = _products(whitened, [column], made, k)
    mean = found[:k, k] / model.n
    gap = np.abs(found[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k))[np.ix_(live, live)]
    return float(gap.max(initial=0.0))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """One row for each vector and component."""
    docs = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(docs)
    found = whiten(docs, model)
    error = identity_error(found, model) if model else 0.0
    shares = F.array(*[F.lit(v) for v in (model.explained if model else [])]).cast("array<double>")
    rows = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
