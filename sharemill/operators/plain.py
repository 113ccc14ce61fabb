"""The network in doubles: softmaxes, He weights, and training in the clear."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import batches
from .model import hash60

#: The sum below which a softmax divides by this instead.
LEAST = 1e-12


def softmax_mean(z: Column, classes: int, temperature: float = 1.0, limit: float | None = None) -> Column:
    """Logits over a temperature, clipped, less their mean, exponentiated and divided by their sum."""
    own = F.transform(z, lambda v: v / max(LEAST, temperature))
    if limit:
        own = F.transform(own, lambda v: F.least(F.greatest(v, F.lit(-float(limit))), F.lit(float(limit))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    powers = F.transform(own, lambda v: F.exp(v - total(own) / classes))
    return F.transform(powers, lambda v: v / F.greatest(total(powers), F.lit(LEAST)))


def softmax_stable(z: Column, classes: int) -> Column:
    """Logits less their maximum, exponentiated and divided by their sum; uniform if that isn't positive."""
    powers = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
    return F.transform(powers, lambda v: F.when(total > 0, v / total).otherwise(F.lit(1.0 / classes)))


def he_value(*key: object) -> float:
    """A standard normal from two keyed hashes."""
    u, v = ((hash60(*key, k) + 0.5) / (1 << 60) for k in (0, 1))
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


def he_start(shape: Sequence[int], seed: str = "he") -> dict[str, np.ndarray]:
    """Weights with deviation sqrt(2 / inputs) and zero biases, for (inputs, hidden, outputs)."""
    out: dict[str, np.ndarray] = {}
    for n, (rows, cols) in {"1": (shape[1], shape[0]), "2": (shape[2], shape[1])}.items():
        out[f"w{n}"] = np.array([[he_value(seed, f"w{n}", i, j) for j in range(cols)] for i in range(rows)]) * math.sqrt(2 / cols)
        out[f"b{n}"] = np.zeros(rows)
    return out


def batch_gradients(x: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray], mode: str = "softmax", temperature: float = 1.0, limit: float | None = None) -> dict[str, np.ndarray]:
    """Sums over rows of the gradients of cross-entropy by mean-shifted softmax, or of the squared error."""
    z1 = x @ w["w1"].T + w["b1"]
    a1 = np.maximum(0.0, z1)
    z = a1 @ w["w2"].T + w["b2"]
    goal = np.eye(len(w["w2"]))[y]
    if mode == "softmax":
        z = z / max(LEAST, temperature)
        z = np.clip(z, -limit, limit) if limit else z
        e = np.exp(z - z.mean(axis=1, keepdims=True))
        d2 = e / np.maximum(e.sum(axis=1, keepdims=True), LEAST) - goal
    else:
        d2 = np.clip((z - goal) / len(w["w2"]), -4.0, 4.0)
    d1 = (d2 @ w["w2"]) * (z1 > 0)
    return {"w1": d1.T @ x, "b1": d1.sum(axis=0), "w2": d2.T @ a1, "b2": d2.sum(axis=0)}


def summed_gradients(rows: DataFrame, w: dict[str, np.ndarray], **how: object) -> tuple[dict[str, np.ndarray], int]:
    """Gradients over rows(x array<double>, label int) and their number: an array of the model's size
    for each task, summed by place in Spark, so the driver gets one array."""
    names = list(w)
    sizes = [w[n].size for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes) + 1)
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                g = batch_gradients(x, b.column(1).to_numpy(zero_copy_only=False), w, **how)
                total += np.concatenate([*(g[n].ravel() for n in names), [b.num_rows]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    cells = rows.select("x", "label").mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("k", "v"))
    found = dict(cells.groupBy("k").agg(F.sum("v")).collect())  # as many rows as the model has weights
    flat = np.array([found.get(k, 0.0) for k in range(sum(sizes) + 1)])
    parts = np.split(flat[:-1], np.cumsum(sizes)[:-1])
    return {n: p.reshape(w[n].shape) for n, p in zip(names, parts, strict=True)}, int(flat[-1])


def train(x: DataFrame, w: dict[str, np.ndarray], rate: float, batch: int, epochs: int, seed: int = 2026, decay: float = 0.95, clip: float | None = None, **how: object) -> dict[str, np.ndarray]:
    """x(id, x, label): slices of exactly `batch` rows in a keyed order per epoch, stored once an epoch and
    gone through a stretch of slices at a time, one job each; slices above batches.STRETCH_ROWS are a job each,
    their gradients summed over tasks. The rate decays by epoch and mean gradients are cut at `clip`.
    An empty table leaves the weights as they are."""
    spark, own = x.sparkSession, x.select("id", "x", "label")
    n = own.count()
    groups = -(-n // batch)
    w = {k: v.copy() for k, v in w.items()}
    names, shapes = list(w), {k: v.shape for k, v in w.items()}
    cuts = np.cumsum([v.size for v in w.values()])[:-1]
    split = lambda flat: {k: part.reshape(shapes[k]) for k, part in zip(names, np.split(flat, cuts), strict=True)}
    home, schema = batches.new_folder(spark, "plain"), own.withColumns({"batch": F.lit(0).cast("long"), "pos": F.lit(0)}).schema

    def stepped(w: dict[str, np.ndarray], g: dict[str, np.ndarray], rows: int, epoch: int) -> dict[str, np.ndarray]:
        means = {k: g[k] / max(1, rows) for k in w}
        return {k: v - rate * decay**epoch * (np.clip(means[k], -clip, clip) if clip else means[k]) for k, v in w.items()}

    for epoch in range(epochs if n else 0):
        path, b = batches.cluster(own, home, batch, seed, epoch), 0

        def fold(flat: np.ndarray, x: np.ndarray, y: np.ndarray, _: int, epoch: int = epoch) -> np.ndarray:
            w = split(flat)
            return np.concatenate([v.ravel() for v in stepped(w, batch_gradients(x, y, w, **how), len(y), epoch).values()])

        while b < groups:
            if batch > batches.STRETCH_ROWS:
                w, end = stepped(w, *summed_gradients(batches.read_batch(spark, path, b, batch, schema), w, **how), epoch), b + 1
            else:
                end = batches.stretch_end(b, groups, batch)
                w = split(batches.stretch(spark, path, b, end, batch, schema, np.concatenate([v.ravel() for v in w.values()]).astype(np.float64), fold))
            b = end
        batches.delete(spark, path)
    return w


def rows(w: dict[str, np.ndarray]) -> list[tuple[str, int, int, float]]:
    return [(n, i, j, float(v)) for n, m in w.items() for (i, j), v in np.ndenumerate(m.reshape(len(m), -1))]
