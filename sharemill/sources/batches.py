"""Minibatches stored in the order in which they are read, steps taken a stretch of minibatches at a time, and
weights committed after each stretch, so that a job reads its own rows and a run goes on from its last commit."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.field import hash60
from ..streaming.streams import shared_dir

#: Rows to a part (a folder) of the store at least, bytes to a group of rows within it, bits of the
#: keyed hash below those that bin rows, and commits that are kept.
PART_ROWS, GROUP_BYTES, BIN_BITS, KEPT = 1 << 18, 1 << 20, 48, 3
#: Rows of a stretch at most: minibatches that one task goes through, as each step needs the one before.
STRETCH_ROWS = 1 << 15


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/training/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def _found(spark: SparkSession, pattern: str) -> list[str]:
    fs, path = _fs(spark, pattern)
    return sorted(str(s.getPath()) for s in fs.globStatus(path) or [])


def delete(spark: SparkSession, path: str) -> None:
    fs, own = _fs(spark, path)
    fs.delete(own, True)


def ordered(rows: DataFrame, seed: int, epoch: int, key: str = "id") -> DataFrame:
    """rows with n, their place from 0 in the epoch's keyed order. Places come from bins of the hash and
    the counts of the bins before, 4096 of them at most, so no task ranks a whole epoch. Rows of one key
    follow each other by their other columns."""
    others = [c for c in rows.columns if c != key]
    own = rows.withColumn("turn", hash60(str(seed + epoch), F.col(key))).withColumn("tie", F.xxhash64(*others) if others else F.lit(0)).withColumn("bin", F.shiftright("turn", BIN_BITS))
    counts = own.groupBy("bin").count()
    before = counts.select("bin", (F.sum("count").over(Window.orderBy("bin")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("turn", key, "tie")) - 1
    return own.withColumn("rank", rank).join(F.broadcast(before), "bin").select(*rows.columns, (F.col("rank") + F.col("before")).alias("n"))


def parts_of(batch: int) -> int:
    """Batches to a part."""
    return max(1, -(-PART_ROWS // batch))


def cluster(rows: DataFrame, base: str, batch: int, seed: int, epoch: int, key: str = "id") -> str:
    """Writes an epoch once: slices of exactly `batch` rows in keyed order (the last is shorter), a folder
    for each parts_of(batch) of them, in order within. A store that is complete is left as it is."""
    spark, path = rows.sparkSession, f"{base}/epoch={epoch:05d}"
    if not _found(spark, f"{path}/_SUCCESS"):
        own = ordered(rows, seed, epoch, key)
        own = own.select(*rows.columns, F.expr(f"n div {batch}").alias("batch"), (F.col("n") % batch).cast("int").alias("pos")).withColumn("part", F.expr(f"batch div {parts_of(batch)}"))
        own.repartition("part").sortWithinPartitions("part", "batch", "pos").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", GROUP_BYTES // 16).partitionBy("part").parquet(path)
    return path


def read_batch(spark: SparkSession, path: str, b: int, batch: int, schema) -> DataFrame:
    """One batch: its part's folder alone is listed, and groups of other batches are passed over."""
    own = spark.read.schema(schema).parquet(f"{path}/part={b // parts_of(batch)}")
    return own.where(F.col("batch") == b)


def stretch_end(b: int, batches: int, batch: int) -> int:
    """Where a stretch from batch b ends: within its part, and after STRETCH_ROWS at most."""
    per = parts_of(batch)
    return min(b + max(1, STRETCH_ROWS // batch), batches, (b // per + 1) * per)


def stretch(spark: SparkSession, path: str, b: int, end: int, batch: int, schema, state: np.ndarray, fold: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """The flat state after fold(state, x, label, batch) of the batches b..end-1 of one part, in order. A label
    that is null is -1."""
    own = spark.read.schema(schema).parquet(f"{path}/part={b // parts_of(batch)}")
    own = own.where(F.col("batch").between(b, end - 1)).select("batch", "pos", "x", "label")
    kind = "double" if state.dtype == np.float64 else "long"

    def run(t: pa.Table) -> pa.Table:
        t, now = t.sort_by([("batch", "ascending"), ("pos", "ascending")]), state
        at = t.column("batch").to_numpy()
        for k in range(b, end):
            lo, hi = np.searchsorted(at, [k, k + 1]).tolist()
            rows = t.slice(lo, hi - lo)
            x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
            now = fold(now, x, rows.column("label").combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False), k)
        return pa.table({"state": pa.array([now.tolist()], pa.list_(pa.float64() if kind == "double" else pa.int64()))})

    return np.array(own.groupBy().applyInArrow(run, f"state array<{kind}>").first()[0], state.dtype)


def commit(spark: SparkSession, base: str, step: int, rows: Sequence[tuple], schema: str) -> None:
    """The weights after so many steps, as a version of their own; only the last KEPT versions stay."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{base}/weights/v={step:09d}")
    for old in _found(spark, f"{base}/weights/v=*")[:-KEPT]:
        delete(spark, old)


def last_commit(spark: SparkSession, base: str) -> tuple[int, str] | None:
    """The last version whose write ended, and its path: what was being written when a run died has no
    mark and is passed over."""
    found = _found(spark, f"{base}/weights/v=*/_SUCCESS")
    if not found:
        return None
    path = found[-1].removesuffix("/_SUCCESS")
    return int(path.rpartition("=")[2]), path
