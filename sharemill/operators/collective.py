"""Collective sums among parties: reduce-scatter and all-gather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.field import modsum


def owner(idx: Column, n: int) -> Column:
    """The party 1..n that sums an index up."""
    return (F.pmod(idx, F.lit(n)) + 1).cast("int")


def reduce_scatter(rows: DataFrame, n: int, p: int) -> DataFrame:
    """rows(party, idx, y) -> (owner, idx, y, terms): each party's own sum of an index goes to the index's
    owner, who adds the parties' up. The sender is a salt of its own: a hot index meets in as many
    groups as there are parties first, and n values of it then. Rows without an index or a value
    are left out."""
    own = rows.where(F.col("idx").isNotNull() & F.col("y").isNotNull())
    sent = own.groupBy("party", "idx").agg(modsum(F.col("y"), p).alias("part"), F.count("*").alias("k"))
    return sent.groupBy(owner(F.col("idx"), n).alias("owner"), "idx").agg(modsum(F.col("part"), p).alias("y"), F.sum("k").alias("terms"))


def all_gather(owned: DataFrame, n: int) -> DataFrame:
    """(dest, owner, idx, y, terms): every party receives every owner's sums; no shuffle."""
    return owned.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("dest"), *owned.columns)
