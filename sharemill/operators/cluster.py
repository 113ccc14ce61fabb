"""A store of several nodes: quorum writes, compare-and-set, reads, and the commits of a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kv


def to_nodes(log: DataFrame, nodes: Sequence[int], delivered: Column) -> DataFrame:
    """A row per write and node, with whether it got there. delivered may read node_id."""
    return log.withColumn("node_id", F.explode(F.lit(list(nodes)))).withColumn("delivered", delivered)


def majority(nodes: int) -> int:
    return nodes // 2 + 1


def quorum_put(sent: DataFrame, key: str, order: Sequence[str], write: Sequence[str], need: int) -> DataFrame:
    """sent(key, order..., version, node_id, delivered) -> (write, acks, ok): a node takes a write if its
    version exceeds all that reached the node before. One shuffle by key and node, one of the counts."""
    before = Window.partitionBy(key, "node_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(F.col("delivered"), F.col("version"))).over(before)
    own = sent.withColumn("accepted", F.col("delivered") & (best.isNull() | (F.col("version") > best)))
    return own.groupBy(*write).agg(F.count_if("accepted").alias("acks")).withColumn("ok", F.col("acks") >= need)


def quorum_cas(sent: DataFrame, key: str, order: Sequence[str], write: str, need: int) -> DataFrame:
    """(write, acks, ok): each node compares and sets by itself. A write that didn't reach a node
    expects nothing there, so it neither succeeds nor changes the node."""
    own = sent.withColumn("_at", F.concat_ws("|", F.col(key).cast("string"), F.col("node_id").cast("string")))
    own = own.withColumn("expected", F.when(F.col("delivered"), F.col("expected")))
    done = kv.compare_and_set(own, "_at", [*order, write])
    return done.groupBy(write).agg(F.count_if("success").alias("acks")).withColumn("ok", F.col("acks") >= need)


def replicas(sent: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, node_id, version, value): what each node holds after all writes that reached it."""
    return kv.latest(sent.where("delivered"), [key, "node_id"], order)


def read_first(held: DataFrame, wanted: DataFrame, key: str, min_version: int) -> DataFrame:
    """wanted keys with node_id, version and value from the first node that is fresh enough, else nulls."""
    first = held.where(F.col("version") >= min_version).groupBy(key).agg(F.min_by(F.struct("node_id", "version", "value"), "node_id").alias("f"))
    return wanted.join(first, key, "left").select(key, "f.node_id", "f.version", "f.value")


def commits(log: DataFrame, key: str, order: Sequence[str], mirrored: Column) -> DataFrame:
    """A model's commits by compare-and-set at an authority, with a mirror that misses some:
    (key, version, mirror_version, commits, repaired). A load repairs a mirror that lags behind."""
    done = kv.compare_and_set(log, key, order).where("success")
    last = done.groupBy(key).agg(F.max("version").alias("version"), F.max(F.when(mirrored, F.col("version"))).alias("mirror_version"), F.count("*").alias("commits"))
    return last.withColumn("repaired", F.coalesce(F.col("mirror_version") < F.col("version"), F.lit(True)))


def side_by_side(log: DataFrame, step: str, side: str, left: str, right: str, order: Sequence[str]) -> DataFrame:
    """(step, inputs, targets, version) of a minibatch whose two sides are written apart: the latest of
    each and the later version, in one aggregation; steps with one side only are left out."""
    at = F.struct(F.col("version"), *(F.col(c) for c in order))
    best = lambda s: F.max_by(F.struct("version", "value"), F.when(F.col(side) == s, at))
    own = log.groupBy(step).agg(best(left).alias("i"), best(right).alias("t"), F.count_if(F.col(side) == left).alias("n"), F.count_if(F.col(side) == right).alias("m"))
    return own.where("n > 0 and m > 0").select(step, F.col("i.value").alias("inputs"), F.col("t.value").alias("targets"), F.greatest("i.version", "t.version").alias("version"))
