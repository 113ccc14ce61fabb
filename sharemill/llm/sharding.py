"""Consistent-hash ring with virtual nodes and bounded loads. A key belongs to the next virtual node
clockwise; a full shard passes its overflow on clockwise. Loads are exact quotas, so row counts
of any two shards differ by one at most."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: The ring has 2^RING_BITS cells; a shard has VNODES places on it. Both bound what is sent to the driver.
RING_BITS, VNODES = 15, 64
#: Ranks of a repeated row that are written out at a time.
BLOCK = 1 << 14


def ring(n_shards: int, vnodes: int = VNODES, bits: int = RING_BITS) -> np.ndarray:
    """The shard that owns each cell. A further shard only takes cells, it never moves others."""
    owner = np.full(1 << bits, -1, np.int64)
    for shard in range(n_shards):
        for v in range(vnodes):
            at = xxhash.xxh64_intdigest(f"{shard}/{v}".encode(), 42) >> (64 - bits)
            if owner[at] < 0:
                owner[at] = shard
    places = np.flatnonzero(owner >= 0)
    nxt = places[np.searchsorted(places, np.arange(1 << bits)) % len(places)]
    return owner[nxt]


def bounded_loads(counts: np.ndarray, owner: np.ndarray, n_shards: int) -> pd.DataFrame:
    """Which ranks of which cells go to which shard: cell, lo, hi (exclusive), shard, slot (of lo).
    Shards first admit keys of their own cells in ring order up to their quota; the overflow then
    continues clockwise from its cell to shards that have room."""
    total = int(counts.sum())
    room = np.full(n_shards, total // n_shards, np.int64)
    room[: total % n_shards] += 1
    used, out, over = np.zeros(n_shards, np.int64), [], []
    for cell in np.flatnonzero(counts).tolist():
        s, n = int(owner[cell]), int(counts[cell])
        k = min(n, int(room[s] - used[s]))
        if k:
            out.append((cell, 0, k, s, int(used[s])))
            used[s] += k
        if k < n:
            over.append((cell, k, n))
    size = len(owner)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for cell, lo, hi in over:
        at = int(np.searchsorted(starts, cell, side="right"))
        while lo < hi:
            s = int(owner[starts[at % len(starts)]])
            k = min(hi - lo, int(room[s] - used[s]))
            if k:
                out.append((cell, lo, lo + k, s, int(used[s])))
                used[s] += k
                lo += k
            at += 1
    assert size and int(used.sum()) == total
    return pd.DataFrame(out, columns=["cell", "lo", "hi", "shard", "base"]).astype("int64")


def assign(docs: DataFrame, n_shards: int = 24, vnodes: int = VNODES) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8; law is `rows`; slot is gapless from 0 in each shard;
    grown_shard is null under this law. The place on the ring is the hash of doc_id; a null
    doc_id's is that of its text. Rows that are alike in doc_id, size and checksum are counted
    before they are shuffled, so a row repeated any number of times is one. Null texts are empty;
    an empty table gives no rows; extra columns are ignored."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(F.col("doc_id").cast("long"), (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    place = F.xxhash64(F.coalesce(F.col("doc_id"), F.col("text_crc32")))
    cell = F.shiftrightunsigned(place, 64 - RING_BITS).alias("cell")
    rows = materialize(narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).select("*", cell), "rows")
    counted = rows.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # a row for each cell of the ring at most
    counts = np.zeros(1 << RING_BITS, np.int64)
    counts[counted["cell"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    plan = bounded_loads(counts, ring(n_shards, vnodes), n_shards)
    spark = docs.sparkSession
    by = spark.createDataFrame(plan, "cell long, lo long, hi long, shard long, base long")
    w = Window.partitionBy("cell").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("first", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    meets = (ranked.cell == by.cell) & (ranked["first"] < by.hi) & (ranked["first"] + ranked.n > by.lo)
    # the plan has a row for each cell and a few for each full shard: bounded by the ring, not by rows
    parts = ranked.join(F.broadcast(by), meets).select(
        "doc_id", "size", "text_crc32", "shard", "base", "lo",
        F.greatest("first", "lo").alias("from"), (F.least(F.expr("first + n"), F.col("hi")) - 1).alias("upto"),
    )
    # a row that repeats has an array of blocks, and each of those one of ranks, so no array gets long
    parts = parts.withColumn("block", F.explode(F.sequence("from", "upto", F.lit(BLOCK).cast("long"))))
    parts = parts.withColumn("rank", F.explode(F.sequence("block", F.least(F.col("block") + BLOCK - 1, F.col("upto")))))
    return parts.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"),
        (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def moved(n_rows: np.ndarray, before: int, after: int, vnodes: int = VNODES) -> float:
    """The share of rows whose shard differs between two ring sizes, for row counts by cell."""
    a, b = (bounded_loads(n_rows, ring(n, vnodes), n) for n in (before, after))
    both = a.merge(b, on="cell", suffixes=("", "_b"))
    same = both[both["shard"] == both["shard_b"]]
    kept = (np.minimum(same["hi"], same["hi_b"]) - np.maximum(same["lo"], same["lo_b"])).clip(lower=0).sum()
    return 1 - kept / max(1, n_rows.sum())
