"""Matrices as (i, j, y) rows, and as one array per row where one side is small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.field import modsum, mulmod, rescale


def matmul(a: DataFrame, b: DataFrame, p: int | None = None) -> DataFrame:
    """a(i, k, y), b(k, j, y) -> (i, j, y): an equi-join on the contraction index and a sum, mod p
    or as plain integers. Without rescaling."""
    terms = a.select("i", "k", F.col("y").alias("l")).join(b.select("k", "j", F.col("y").alias("r")), "k")
    if p is None:
        return terms.groupBy("i", "j").agg(F.sum(F.col("l") * F.col("r")).cast("long").alias("y"))
    return terms.groupBy("i", "j").agg(modsum(mulmod(F.col("l"), F.col("r"), p), p).alias("y"))


def dot(x: Column, w: Sequence[int]) -> Column:
    """An array column times a fixed row of small integers."""
    return F.aggregate(F.zip_with(x, F.lit(list(w)).cast("array<bigint>"), lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v)


def dense(x: Column, w: Sequence[Sequence[int]], bias: Sequence[int], scale: int) -> Column:
    """W x + b in fixed point, rounded once per output: weights are literals, so nothing is joined."""
    return F.zip_with(F.array(*(dot(x, row) for row in w)), F.lit(list(bias)).cast("array<bigint>"), lambda v, b: rescale(v, scale) + b)


def dense_per_term(x: Column, w: Sequence[Sequence[int]], scale: int) -> Column:
    """W x with every product rounded before the sum."""
    total = lambda row: F.aggregate(F.zip_with(x, F.lit(list(row)).cast("array<bigint>"), lambda a, b: rescale(a * b, scale)), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.array(*(total(row) for row in w))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "y")


def add(a: DataFrame, b: DataFrame, p: int) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(modsum(F.col("y"), p).alias("y"))


def scale_by(a: DataFrame, c: int, p: int) -> DataFrame:
    return a.withColumn("y", mulmod(F.col("y"), c % p, p))


#: The outer form is used on computed arrays that are never empty: the plain one adds a filter on the
#: array's size, which Spark would push below and so work out everything twice over.
def long_form(df: DataFrame, key: str, array: str, value: str = "y", at: str = "j") -> DataFrame:
    return df.select(key, F.posexplode_outer(array).alias(at, value))
