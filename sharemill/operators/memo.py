"""A memoised function over a table of keys: what was worked out before is read, only the rest is worked
out, and is kept as a new part of the table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import _found, delete

#: Parts from which on they are written into one.
COMPACT = 8


@dataclass
class Memo:
    """compute(keys) gives a row (key, value columns) for each row of keys. Parts of the table are folders
    whose write ended; one that broke off has no mark and is passed over, and written again."""

    path: str
    key: str
    compute: Callable[[DataFrame], DataFrame]
    metrics: dict[str, int] = field(default_factory=lambda: {"hits": 0, "misses": 0, "parts": 0})

    def parts(self, spark: SparkSession) -> list[str]:
        done = [p.removesuffix("/_SUCCESS") for p in _found(spark, f"{self.path}/part=*/_SUCCESS")]
        merged = [p for p in done if p.endswith("-all")]
        return [p for p in done if p >= merged[-1]] if merged else done

    def known(self, spark: SparkSession) -> DataFrame | None:
        found = self.parts(spark)
        return spark.read.parquet(*found) if found else None

    def lookup(self, keys: DataFrame) -> DataFrame:
        """keys(key, ...) -> their rows with the value columns and hit, which says whether the value was there
        before. Each missing key is worked out once, however often it is asked for. Null keys have
        null values and hit nothing."""
        spark = keys.sparkSession
        before = self.known(spark)
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        misses = asked if before is None else asked.join(before.select(self.key), self.key, "left_anti")
        number = len(_found(spark, f"{self.path}/part=*"))
        new = f"{self.path}/part={number:06d}"
        self.compute(misses).write.mode("overwrite").parquet(new)
        fresh = spark.read.parquet(new)
        n, every = fresh.count(), asked.count()
        values = fresh.withColumn("hit", F.lit(False))
        if before is not None:
            values = values.unionByName(before.withColumn("hit", F.lit(True)))
        if not n:
            delete(spark, new)
            values = values if before is None else before.withColumn("hit", F.lit(True))
            values = spark.createDataFrame([], values.schema) if before is None else values
        self.metrics = {"hits": every - n, "misses": n, "parts": len(self.parts(spark))}
        return keys.join(values, self.key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def compact(self, spark: SparkSession) -> None:
        """Writes the parts into one where there are COMPACT or more. Older parts go once it is whole; who
        reads them meanwhile must read again."""
        found = self.parts(spark)
        if len(found) < COMPACT:
            return
        number = int(found[-1].rpartition("=")[2].removesuffix("-all")) + 1
        spark.read.parquet(*found).write.mode("overwrite").parquet(f"{self.path}/part={number:06d}-all")
        for old in found:
            delete(spark, old)
