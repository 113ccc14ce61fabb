"""Streaming twins: event files are read as a stream, state is kept by Structured Streaming, and
results land in a table of the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; a local one only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or "file://" + os.path.join(tempfile.gettempdir(), "sharemill-streams")


#: Files that a replay is cut into, each a micro-batch.
FILES = 6


def replayed(df: DataFrame, ts: str, files: int = FILES, mixed: bool = False, end: dict | None = None) -> tuple[DataFrame, str]:
    """df as a stream of several files by time, one a micro-batch, and how late its rows come at most: in
    order, or mixed, each pair of neighbours exchanged. end: values of a last row that comes after all
    others, to move time on."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/streams/replay-{uuid.uuid4().hex}"
    df.repartitionByRange(files, ts).write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    found = sorted((str(f.getPath()) for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda p: p.rpartition("/")[2])
    if mixed:
        found = [found[k ^ 1] if k ^ 1 < len(found) else found[k] for k in range(len(found))]
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    bounds = {r.f.rpartition("/")[2]: r for r in spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min(us).alias("lo"), F.max(us).alias("hi")).collect()}  # a row for each file
    late, latest = 0, None
    for b in (bounds[n] for n in (p.rpartition("/")[2] for p in found) if n in bounds):
        if b.lo is not None:
            late, latest = max(late, latest - b.lo if latest is not None else 0), max(b.hi, latest if latest is not None else b.hi)
    if end:
        last = df.limit(0).unionByName(spark.createDataFrame([tuple(end.values())], list(end)), allowMissingColumns=True).select(*(F.col(c).cast(df.schema[c].dataType) for c in df.columns))
        last.coalesce(1).write.mode("append").parquet(path)
        now = {str(f.getPath()) for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")}
        found += sorted(now - set(found))
    for k, p in enumerate(found):  # files are read by their time
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(p), 1_600_000_000_000 + 60_000 * k, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), f"{late // 1_000_000 + 1} seconds"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in order, over several micro-batches."""
    return replayed(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts")[0]


#: What keeps the state of transformWithState.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the micro-batches of the last run did, by its name: rows in, and rows of state after.
PROGRESS: dict[str, list[tuple[int, int]]] = {}


def run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs to the end of what is there and gives the table. Append writes files directly; other
    modes replace the table with each batch."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        if mode == "append":
            query = writer.format("parquet").option("path", f"{base}/table").start()
        else:
            query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/table")).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    PROGRESS[name] = [(p["numInputRows"], sum(o["numRowsTotal"] for o in p["stateOperators"])) for p in query.recentProgress]
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def last_seen(stream: DataFrame) -> DataFrame:
    """Per node: the last beat and how many came, from state."""
    return stream.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("beats"))


def sampler(stream: DataFrame, every: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Tumbling windows of samples behind a watermark. In append mode the last window stays open."""
    w = F.window("ts", every)
    own = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return own.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("peak")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "peak")


def membership(stream: DataFrame) -> DataFrame:
    """Per node: whether its last join or drop was a join."""
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 0)
    return stream.where(kind.isNotNull()).groupBy("user_id").agg(F.max_by(kind, F.struct("ts", "event_id")).alias("active"))


#: Rows of a table to a bucket of keys whose state is kept together, and the bucket of rows without a node.
BUCKET_ROWS, NO_NODE = 1 << 14, -1


def buckets(df: DataFrame) -> int:
    """How many buckets the keys of df are dealt into: their number grows with the rows, their size doesn't."""
    return max(8, -(-df.count() // BUCKET_ROWS))


def failures(stream: DataFrame, node: str, timeout_hours: int, grace_end_us: int = 0, buckets: int = 64) -> DataFrame:
    """(node, failed_at, recovered_at): silences longer than the timeout, found from grace_end_us on. A
    node's state is its last beat; when the watermark passes the timeout, the node is reported with a
    null recovered_at and its state dropped. Nodes are dealt into buckets by a hash: a bucket's
    beats are gone through in one call, and its timer on event time fires for the first node that is due.
    Beats behind the watermark are late and left out."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    gap = timeout_hours * 3_600_000_000

    def watch(key, frames, state):
        held, last = (np.frombuffer(bytes(b), np.int64) for b in state.get) if state.exists else (np.zeros(0, np.int64),) * 2
        new = [f for f in frames if not state.hasTimedOut]
        # in the order of node and time, with the last beat of each before its new ones
        nodes = np.concatenate([held, *(f["node"].to_numpy(np.int64) for f in new)])
        us = np.concatenate([last, *(f["us"].to_numpy(np.int64) for f in new)])
        came = np.arange(len(nodes)) >= len(held)
        order = np.lexsort((us, came, nodes))
        nodes, us, came = nodes[order], us[order], came[order]
        fails = np.maximum(us + gap, grace_end_us)
        same = nodes[1:] == nodes[:-1]
        back = np.flatnonzero(same & (us[1:] > fails[:-1]))
        ends = np.r_[~same, True][: len(nodes)]
        due = ends & ~came & (fails // 1000 < state.getCurrentWatermarkMs())
        stays = ends & ~due
        if stays.any():
            state.update((nodes[stays].tobytes(), us[stays].tobytes()))
            state.setTimeoutTimestamp(max(int(fails[stays].min()) // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        ids = np.r_[nodes[back], nodes[due]]
        if key[0] == NO_NODE:
            ids = [None] * len(ids)
        recovered = pd.array([*us[back + 1].tolist(), *[None] * int(due.sum())], "Int64")
        yield pd.DataFrame({"node": pd.array(ids, "Int64"), "failed": np.r_[fails[back], fails[due]], "recovered": recovered})

    own = stream.select(F.col(node).cast("long").alias("_node"), F.col("ts").cast("timestamp").alias("ts")).withColumn("us", F.unix_micros("ts")).withWatermark("ts", "0 seconds")
    own = own.withColumn("bucket", F.when(F.col("_node").isNull(), NO_NODE).otherwise(F.pmod(F.xxhash64("_node"), F.lit(buckets)))).withColumn("node", F.coalesce("_node", F.lit(0))).drop("_node")
    found = own.groupBy("bucket").applyInPandasWithState(watch, "node long, failed long, recovered long", "nodes binary, last binary", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("node", F.timestamp_micros("failed").alias("failed_at"), F.timestamp_micros("recovered").alias("recovered_at"))
