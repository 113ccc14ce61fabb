"""A versioned key-value store as an append-only log of writes (key, version, value, arrival order)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def accepted(log: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds accepted: a write counts if its version exceeds all earlier ones of its key."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("version").over(before)
    return log.withColumn("accepted", best.isNull() | (F.col("version") > best))


def latest(log: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(key, version, value): the first write of the highest version, by one combined aggregation."""
    first = F.struct(F.col("version"), *(F.struct(*(_down(log, c) for c in order)).alias("o"),))
    return log.groupBy(*key).agg(F.max_by(F.struct("version", "value"), first).alias("w")).select(*key, "w.version", "w.value")


def _down(log: DataFrame, c: str) -> Column:
    kind = log.schema[c].dataType.simpleString()
    return (-F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else -F.col(c)).alias(c)


def fresh(current: DataFrame, wanted: DataFrame, key: Sequence[str], min_version: int | Column) -> DataFrame:
    """wanted keys with version and value, null where the key is missing or older than asked for."""
    least = F.lit(min_version) if isinstance(min_version, int) else min_version
    return wanted.join(current.where(F.col("version") >= least), list(key), "left")


def compare_and_set(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """log(key, order..., expected, version) -> adds success and current (the version after it).

    A write succeeds on an absent key if expected is 0 or -1, else if expected is the current
    version and its own is higher; with a null expected it never does. The outcome depends on the ones before, so a key's writes are
    folded in order: Arrow batches of a key's partition, sorted, with the key's state carried over."""
    import pyarrow as pa

    cols = [key, *order, "expected", "version"]
    own = log.select(*cols).repartition(F.col(key)).sortWithinPartitions(key, *order)
    schema = StructType([*own.schema.fields, StructField("success", BooleanType()), StructField("current", LongType())])
    names = [f.name for f in schema]

    def fold(batches):
        last, current = None, None
        for b in batches:
            ok, now = [], []
            for k, expected, version in zip(b.column(0).to_pylist(), b.column(len(cols) - 2).to_pylist(), b.column(len(cols) - 1).to_pylist(), strict=True):
                if k != last:
                    last, current = k, None
                good = expected in (0, -1) if current is None else expected == current and version > expected
                current = version if good else current
                ok.append(good)
                now.append(current)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_()), pa.array(now, pa.int64())], names=names)

    return own.mapInArrow(fold, schema)


def quorum(writes: DataFrame, key: Sequence[str], nodes: int, need: int | None = None) -> DataFrame:
    """writes(key, node_id, accepted) -> (key, acks, ok): a majority of nodes unless given."""
    need = need or nodes // 2 + 1
    return writes.groupBy(*key).agg(F.count_if("accepted").alias("acks")).withColumn("ok", F.col("acks") >= need)
