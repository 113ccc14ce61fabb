"""Whitening of vectors by TSQR: centred rows are reduced to a triangular factor in each partition, the
factors are merged as a tree, and the right singular vectors of the last one whiten. The covariance is
never formed."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: x = floor(SCALE * c) + SHIFT. Entries beyond EDGE don't fit exactly.
SCALE, SHIFT, EDGE = 64, 1_000_000, float(1 << 46)
#: Components at most; rows to a block; factors that meet in a task.
MOST, BLOCK, MERGE = 16, 4096, 16
#: A component whose singular value is under this part of the largest has no variance.
RANK = 1e-12
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(df: DataFrame, vector: str) -> tuple[Column, Column]:
    """Whether a row stays, and its x as array<bigint>: vectors shorter than the longest that stays are
    padded with entries of 0."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < EDGE))
    d = df.where(fine).agg(F.max(F.size(vector))).first()[0] or 0
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return fine, F.concat(x, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(d) - F.size(v)))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[np.ndarray]:
    for b in batches:
        own = matrix(b.column(b.schema.get_field_index(column)))
        for lo in range(0, len(own), BLOCK):
            yield own[lo : lo + BLOCK]


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension; a task gives a row for each dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for x in blocks(batches, "x"):
            n, s = n + len(x), [int(a) + b for a, b in zip(x.sum(axis=0), s or [0] * x.shape[1], strict=True)]
        s = s or []
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, len(s)), pa.int32()), "s": pa.array([str(v) for v in [n, *s]])})

    found = fit.select("x").mapInArrow(part, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by = {r.dim: int(r.s) for r in found.collect()}  # a row for each dimension
    return by.get(-1, 0), [by[k] for k in range(len(by) - 1)]


def centre(n: int, s: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x -> x - s / n, rounded once: s = n * whole + rest, and the whole part goes in integers."""
    whole = np.array([v // n for v in s], np.int64)
    rest = np.array([v % n / n for v in s])
    return lambda x: (x - whole).astype(np.float64) - rest


def triangular(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def factor(fit: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """The triangular factor of the centred rows: one for each partition, then MERGE of them at a time
    until one remains. Each is of the dimension's square, however many rows there are."""
    centred, d = centre(n, s), len(s)
    pack = lambda r: np.ascontiguousarray(r, np.float64).tobytes()
    unpack = lambda b: np.frombuffer(b).reshape(-1, d)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, d))
        for x in blocks(batches, "x"):
            r = triangular(np.vstack([r, centred(x)]))
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([pack(r)], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        r = np.empty((0, d))
        for b in t.column("r").to_pylist():
            r = triangular(np.vstack([r, unpack(b)]))
        return pa.table({"part": pa.array([t.column("part")[0].as_py() // MERGE], pa.int64()), "r": pa.array([pack(r)], pa.binary())})

    found = materialize(fit.select("x").mapInArrow(local, "part long, r binary"), "factors")
    while not found.where("part > 0").isEmpty():
        found = materialize(found.groupBy(F.expr(f"part div {MERGE}").alias("to")).applyInArrow(merge, "part long, r binary"), "factors")
    return unpack(found.first()["r"])


def whitener(r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions as columns divided by their deviations, the parts of the variance that they explain,
    and which have variance. Of both signs, the one whose largest entry is positive."""
    _, sv, vt = np.linalg.svd(r, full_matrices=True)
    d = vt.shape[0]
    sv = np.concatenate([sv, np.zeros(d - len(sv))])
    k = min(MOST, d)
    top = vt[:k]
    top = top * np.where(top[np.arange(k), np.abs(top).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    alive = sv[:k] > RANK * max(sv[0], 1e-300) if sv[0] > 0 else np.zeros(k, bool)
    scale = np.where(alive, math.sqrt(n) / np.where(alive, sv[:k], 1.0), 0.0)
    total = float((sv**2).sum())
    return top.T * scale, (sv[:k] ** 2) / total if total else np.zeros(k), alive


def identity_error(fit: DataFrame, n: int, s: list[int], w: np.ndarray, alive: np.ndarray) -> float:
    """The largest entry of the whitened fit rows' covariance minus the identity, over components with
    variance. Rows are centred before they are multiplied; tasks give sums of products."""
    centred, k = centre(n, s), w.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((k, k))
        for x in blocks(batches, "x"):
            own = centred(x) @ w
            g += own.T @ own
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(k * k), pa.int32()), "g": pa.array(g.ravel())})

    found = {r.cell: r.g for r in fit.select("x").mapInArrow(part, "cell int, g double").groupBy("cell").agg(F.sum("g").alias("g")).collect()}  # MOST squared cells
    cov = np.array([found[c] for c in range(k * k)]).reshape(k, k) / n
    return float(np.abs((cov - np.eye(k))[np.ix_(alive, alive)]).max(initial=0.0))


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sums over dimensions of (n * x - s)^2, exact; None where that is beyond a long."""
    whole = np.array([v // n for v in s], np.int64)
    far = int(np.abs(x - whole).max(initial=0)) + 1
    if far * n < 1 << 62 and (far * n) ** 2 * len(s) < 1 << 63:
        gap = n * (x - whole) - np.array([v % n for v in s], np.int64)
        return (gap * gap).sum(axis=1).tolist()
    exact = [sum((n * v - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """df(vec_id, embedding, ...) -> vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error, a row for each row that stays and each of its first MOST components.

    Rows whose vector is null, empty, or holds null, non-finite or (beyond 2^46) inexact entries are
    dropped. The fit list has each distinct integer vector once, so copies don't weigh. Shorter vectors
    are padded with entries of 0. Components without variance (fewer distinct vectors than
    dimensions) give 0 and explain 0. A deviation beyond a long is null. Null ids and repeated rows
    stay; an empty table gives no rows; other columns aren't read."""
    spark = df.sparkSession
    fine, x = integers(df, vector)
    own = materialize(df.where(fine).select(F.col(key).cast("long").alias("vec_id"), x.alias("x")), "integers")
    fit = materialize(own.select("x").distinct(), "fit")
    n, s = sums(fit)
    if not n:
        return spark.createDataFrame([], OUT)
    w, explained, alive = whitener(factor(fit, n, s), n)
    error, k, centred = identity_error(fit, n, s, w, alive), w.shape[1], centre(n, s)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                rows = b.slice(lo, BLOCK)
                mine, many = matrix(rows.column(1)), rows.num_rows
                ids = rows.column(0).take(pa.array(np.repeat(np.arange(many), k)))
                dev = pa.array(deviations(mine, n, s), pa.int64()).take(pa.array(np.repeat(np.arange(many), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, n)), dev, pa.array((centred(mine) @ w).ravel()), pa.array(np.tile(explained, many)), pa.array(np.full(many * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return own.mapInArrow(project, OUT)
