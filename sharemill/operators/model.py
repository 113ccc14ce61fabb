"""A two-layer network in fixed point: weights from keyed hashes, forward pass, gradients, updates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.field import rescale
from ..sources import batches
from ..spec import safe
from .linalg import dense
from .nonlinear import relu, relu_backward, softmax


def hash60(*parts: object) -> int:
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


@dataclass(frozen=True)
class Weights:
    """Rows are outputs. Their number is fixed by the model's shape, not by the data."""

    w1: list[list[int]]
    b1: list[int]
    w2: list[list[int]]
    b2: list[int]

    @staticmethod
    def start(inputs: int, hidden: int, outputs: int, scale: int) -> Weights:
        """Uniform in [-scale, scale] from hashes of layer, row and column; zero biases."""
        draw = lambda layer, i, j: hash60(layer, i, j) % (2 * scale + 1) - scale
        w1 = [[draw("w1", i, j) for j in range(inputs)] for i in range(hidden)]
        w2 = [[draw("w2", i, j) for j in range(hidden)] for i in range(outputs)]
        return Weights(w1, [0] * hidden, w2, [0] * outputs)

    def rows(self) -> list[tuple[str, int, int, int]]:
        out = [(n, i, j, v) for n in ("w1", "w2") for i, row in enumerate(getattr(self, n)) for j, v in enumerate(row)]
        return out + [(n, i, 0, v) for n in ("b1", "b2") for i, v in enumerate(getattr(self, n))]

    def of_rows(self, rows: Sequence) -> Weights:
        """Weights of this shape from rows (layer, i, j, y), all of them."""
        if len(rows) != len(self.rows()):
            raise ValueError(f"{len(rows)} weights, not {len(self.rows())}")
        own = {n: [list(r) if n[0] == "w" else r for r in getattr(self, n)] for n in ("w1", "b1", "w2", "b2")}
        for r in rows:
            if r["layer"][0] == "w":
                own[r["layer"]][r["i"]][r["j"]] = r["y"]
            else:
                own[r["layer"]][r["i"]] = r["y"]
        return Weights(**own)


def shapes(w: Weights) -> list[tuple[str, int, int, int]]:
    """(layer, start, rows, columns) of each layer within one flat vector."""
    out, at = [], 0
    for n in ("w1", "b1", "w2", "b2"):
        v = getattr(w, n)
        cols = len(v[0]) if n[0] == "w" else 1
        out.append((n, at, len(v), cols))
        at += len(v) * cols
    return out


def flat_place(of: list[tuple[str, int, int, int]]) -> Column:
    """The place of (layer, i, j)."""
    return F.coalesce(*(F.when(F.col("layer") == n, F.lit(start) + F.col("i") * cols + F.col("j")) for n, start, _, cols in of)).cast("long")


def unflattened(flat: DataFrame, of: list[tuple[str, int, int, int]]) -> DataFrame:
    """flat(pos, y) -> (pos, layer, i, j, y)."""
    at = F.coalesce(*(F.when(F.col("pos") >= start, F.struct(F.lit(n).alias("layer"), F.lit(start).alias("start"), F.lit(cols).alias("cols"))) for n, start, _, cols in reversed(of)))
    own = flat.withColumn("_a", at).withColumn("_k", F.col("pos") - F.col("_a.start"))
    i = F.expr("cast(_k div _a.cols as int)")
    return own.select("pos", "_a.layer", i.alias("i"), (F.col("_k") - i * F.col("_a.cols")).cast("int").alias("j"), "y")


def forward(x: DataFrame, w: Weights, scale: int) -> DataFrame:
    """Adds z1, a1 and z2 to rows with an array x: no join and no shuffle."""
    own = x.withColumn("z1", dense(F.col("x"), w.w1, w.b1, scale))
    own = own.withColumn("a1", F.transform("z1", relu))
    return own.withColumn("z2", dense(F.col("a1"), w.w2, w.b2, scale))


def gradients(x: DataFrame, w: Weights, scale: int) -> DataFrame:
    """rows (x, label) -> (layer, i, j, y): sums over rows of the gradients of cross-entropy, each
    term rounded, aggregated before they are shuffled."""
    own = softmax(forward(x, w, scale), "z2", len(w.w2), "p", scale)
    own = own.withColumn("dz2", F.transform("p", lambda v, c: v - F.when(c == F.col("label"), F.lit(scale)).otherwise(F.lit(0))))
    columns = list(zip(*w.w2, strict=True))
    da1 = dense(F.col("dz2"), columns, [0] * len(columns), scale)
    own = own.withColumn("dz1", F.zip_with(da1, F.col("z1"), relu_backward))
    outer = lambda d, a: F.flatten(F.transform(d, lambda g: F.transform(a, lambda v: rescale(g * v, scale))))
    parts = F.array(
        *(F.struct(F.lit(n).alias("layer"), F.lit(m).alias("width"), v.alias("v")) for n, m, v in (
            ("w1", len(w.w1[0]), outer(F.col("dz1"), F.col("x"))), ("b1", 1, F.col("dz1")), ("w2", len(w.w1), outer(F.col("dz2"), F.col("a1"))), ("b2", 1, F.col("dz2"))))
    )
    cells = own.select(F.explode(parts).alias("p")).select("p.layer", "p.width", F.posexplode_outer("p.v").alias("k", "g"))
    summed = cells.groupBy("layer", "width", "k").agg(F.sum("g").alias("y"))
    at = F.expr("cast(k div width as int)")
    return summed.select("layer", at.alias("i"), (F.col("k") - at * F.col("width")).cast("int").alias("j"), "y")


def step(w: Weights, grads: list, rate: int, scale: int, batch: int) -> Weights:
    """w - rate * g / (scale * batch), to the nearest. Gradients are as many rows as weights."""

    def near(v: int, d: int) -> int:
        return (1 if v >= 0 else -1) * ((2 * abs(v) + d) // (2 * d))

    own = {n: np.array(getattr(w, n), dtype=object) for n in ("w1", "b1", "w2", "b2")}
    for r in grads:
        at = (r["i"], r["j"]) if r["layer"][0] == "w" else (r["i"],)
        own[r["layer"]][at] -= near(rate * r["y"], scale * batch)
    return Weights(own["w1"].tolist(), own["b1"].tolist(), own["w2"].tolist(), own["b2"].tolist())


def _flat(w: Weights) -> np.ndarray:
    return np.array([r[3] for n in ("w1", "b1", "w2", "b2") for r in w.rows() if r[0] == n], np.int64)


def _weights(flat: np.ndarray, of: list[tuple[str, int, int, int]]) -> Weights:
    parts = {n: flat[start : start + rows * cols].reshape(rows, cols) for n, start, rows, cols in of}
    return Weights(**{n: v.tolist() if n[0] == "w" else v[:, 0].tolist() for n, v in parts.items()})


def _near(v: np.ndarray, d: np.ndarray | int) -> np.ndarray:
    """v / d to the nearest, halves away from zero, as functions.field.rescale has it."""
    size = (2 * np.abs(v) + d) // (2 * np.asarray(d))
    return np.where(v < 0, -size, size)


def _bounded(a: np.ndarray, b: np.ndarray | int, terms: int = 1) -> None:
    """An error where sums of so many products could leave 64 bits, as Spark's arithmetic has it."""
    if a.size and terms * max(abs(int(a.max())), abs(int(a.min()))) * (max(abs(int(b.max())), abs(int(b.min()))) if isinstance(b, np.ndarray) else b) >= 1 << 61:
        raise OverflowError("products leave 64 bits")


def _dense(x: np.ndarray, w: np.ndarray, scale: int) -> np.ndarray:
    _bounded(x, w, w.shape[1])
    return _near(x @ w.T, scale)


def _outer(d: np.ndarray, x: np.ndarray, scale: int) -> np.ndarray:
    """Sums over rows of d's products with x, each rounded."""
    _bounded(d, x, len(x))
    return _near(d[:, :, None] * x[:, None, :], scale).sum(axis=0)


def batch_gradients(x: np.ndarray, label: np.ndarray, w: dict[str, np.ndarray], scale: int) -> dict[str, np.ndarray]:
    """gradients() of one minibatch, the same integers: for steps that follow each other within a task."""
    z1 = _dense(x, w["w1"], scale) + w["b1"]
    a1 = np.maximum(z1, 0)
    z = _dense(a1, w["w2"], scale) + w["b2"]
    c = np.clip(z - z.max(axis=1, keepdims=True), -4 * scale, 4 * scale)
    square, half = _near(_near(c * c, scale), 12), _near(c, 2)
    e = np.clip(_near((square + half + scale) * scale, square - half + scale), 1, scale * 55)
    p = np.clip(_near(e * scale, e.sum(axis=1, keepdims=True)), 0, scale)
    p[np.arange(len(p)), p.argmax(axis=1)] += scale - p.sum(axis=1)
    d2 = p - scale * (np.arange(p.shape[1]) == label[:, None])
    d1 = np.where(z1 > 0, _dense(d2, w["w2"].T, scale), 0)
    return {"w1": _outer(d1, x, scale), "b1": d1.sum(axis=0), "w2": _outer(d2, a1, scale), "b2": d2.sum(axis=0)}


class Paused(RuntimeError):
    """A run that stopped between steps: its commits stay, and the same call goes on from the last."""


def recovered(reason: str, n_active: int, t: int = 1, s: int = 1) -> bool:
    """Whether a pause ends with the same batch tried again: the members that are left must be safe."""
    return reason in ("dropout", "rejoin") and safe(t, s, n_active)


def train(
    x: DataFrame, w: Weights, scale: int, rate: float, batch: int, epochs: int, seed: int = 2026, decay: float = 0.95,
    base: str | None = None, pauses: Callable[[int], tuple[str, int] | None] | None = None, stop_after: int | None = None,
) -> Weights:
    """Minibatches of a keyed order per epoch, slices of exactly `batch` rows (the last is shorter). A stretch of
    slices is one job, in which one task takes their steps one after the other; a slice above
    batches.STRETCH_ROWS is a job of its own over many tasks. A step divides by the rows that it had. Only
    weights or gradients of the model's size reach the driver. x(id, x, label).

    Under base lie the epoch's rows, clustered by batch, and the weights after each job: a call
    with the same base goes on after the last commit. pauses(step) may name a reason and the members
    left; a pause that recovered() ends tries the same batch again, another one raises Paused, as
    does stop_after, a number of steps. An empty table leaves the weights as they are."""
    spark = x.sparkSession
    own = x.select("id", "x", "label")
    n = own.count()
    groups = -(-n // batch)
    home = base or batches.new_folder(spark, "model")
    schema = own.withColumns({"batch": F.lit(0).cast("long"), "pos": F.lit(0)}).schema
    found = batches.last_commit(spark, home)
    at = 0
    if found:
        at, w = found[0], w.of_rows(spark.read.parquet(found[1]).collect())
    of, now = shapes(w), at
    while now < groups * epochs:
        epoch, b = divmod(now, groups)
        end, why, k = b + 1 if batch > batches.STRETCH_ROWS else batches.stretch_end(b, groups, batch), None, b
        while k < end and not why:
            at_step = epoch * groups + k
            if stop_after is not None and at_step - at == stop_after:
                why = f"stopped before step {at_step}"
            elif pauses and (pause := pauses(at_step)) and not recovered(*pause):
                why = f"step {at_step}: {pause[0]} with {pause[1]} members"
            else:
                k += 1
        if k > b:
            path, part = batches.cluster(own, home, batch, seed, epoch), round(rate * decay**epoch * scale)
            if batch > batches.STRETCH_ROWS:
                grads = gradients(batches.read_batch(spark, path, b, batch, schema), w, scale).collect()
                w = step(w, grads, part, scale, min(batch, n - b * batch))
            else:

                def fold(flat: np.ndarray, x: np.ndarray, label: np.ndarray, _: int, part: int = part) -> np.ndarray:
                    cut = {m: flat[start : start + rows * cols].reshape((rows, cols) if m[0] == "w" else rows) for m, start, rows, cols in of}
                    g = batch_gradients(x, label, cut, scale)
                    g = np.concatenate([g[m].ravel() for m, *_ in of])
                    _bounded(g, part)
                    return flat - _near(part * g, scale * len(x))

                w = _weights(batches.stretch(spark, path, b, k, batch, schema, _flat(w), fold), of)
            now += k - b
            batches.commit(spark, home, now, w.rows(), "layer string, i int, j int, y long")
        if why:
            raise Paused(why)
    if base is None:
        batches.delete(spark, home)
    return w


def argmax(v: Column) -> Column:
    """The first place of the largest."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def means(x: DataFrame) -> DataFrame:
    """x(label, x array<long>) -> (layer, i, j, v): the mean vector of each label, to the nearest, as a
    layer's weights."""
    cells = x.select(F.col("label").alias("i"), F.posexplode_outer("x").alias("j", "y"))
    return cells.groupBy("i", "j").agg(F.sum("y").alias("s"), F.count("*").alias("n")).select(F.lit("w").alias("layer"), "i", "j", rescale(F.col("s"), F.col("n")).alias("v"))
