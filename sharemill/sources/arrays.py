"""Archives of named arrays (NPZ): read as rows through Spark's own file reader, so from any file system,
and written through Hadoop's."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import Weights

#: Rows of an array to an output batch.
BLOCK = 4096


def read_arrays(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """(path, name, i, shape, x array<double>): a row for each row of each named array, its further
    dimensions flattened. An archive is a task's (files up to 2 GB); one that lacks an array, or
    holds objects, is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with np.load(io.BytesIO(raw.as_buffer()), allow_pickle=False) as held:
                    missing = sorted(set(names) - set(held.files))
                    if missing:
                        raise ValueError(f"{where} has no arrays {missing}")
                    for name in names:
                        a = held[name]
                        shape, rows = [int(v) for v in a.shape], np.atleast_1d(a).astype(np.float64)
                        flat = rows.reshape(len(rows), -1) if len(rows) else rows.reshape(0, 1)
                        for lo in range(0, len(flat), BLOCK):
                            own = flat[lo : lo + BLOCK]
                            n = len(own)
                            x = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * own.shape[1]), pa.array(own.ravel()))
                            yield pa.RecordBatch.from_arrays([pa.array([where] * n), pa.array([name] * n), pa.array(np.arange(lo, lo + n)), pa.array([shape] * n, pa.list_(pa.int64())), x], names=["path", "name", "i", "shape", "x"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, name string, i long, shape array<long>, x array<double>")


def read_digits(spark: SparkSession, path: str, classes: int = 10, train: int | None = None, test: int | None = None) -> DataFrame:
    """(split, id, x, label, y): the usual four arrays of images and labels, pixels as 0..1, labels one-hot
    too; at most so many of each split, the first by their place."""
    own = read_arrays(spark, path, ["x_train", "y_train", "x_test", "y_test"]).select(F.split("name", "_")[1].alias("split"), F.col("i").alias("id"), F.split("name", "_")[0].alias("side"), "x")
    for split_, n in (("train", train), ("test", test)):
        if n is not None:
            own = own.where((F.col("split") != split_) | (F.col("id") < n))
    images = own.where("side = 'x'").select("split", "id", F.transform("x", lambda v: v / 255).alias("x"))
    labels = own.where("side = 'y'").select("split", "id", F.get("x", F.lit(0)).cast("int").alias("label"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == F.col("label")).cast("int"))
    return images.join(labels, ["split", "id"]).withColumn("y", hot)


LAYERS = ("w1", "b1", "w2", "b2")


def read_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """A model's layers, as large as the model."""
    rows = read_arrays(spark, path, LAYERS).collect()
    own = {n: sorted((r["i"], r["x"]) for r in rows if r["name"] == n) for n in LAYERS}
    shape = {r["name"]: tuple(r["shape"]) for r in rows}
    return {n: np.array([x for _, x in v]).reshape(shape.get(n, (0,))) for n, v in own.items()}


def write_arrays(spark: SparkSession, path: str, **arrays: np.ndarray) -> None:
    """An archive of arrays that the driver holds, such as a model's."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(out.getvalue()))
    finally:
        stream.close()


def write_weights(spark: SparkSession, path: str, w: Weights, scale: int) -> None:
    """Fixed-point weights as doubles."""
    write_arrays(spark, path, **{n: np.array(getattr(w, n), np.float64) / scale for n in LAYERS})
