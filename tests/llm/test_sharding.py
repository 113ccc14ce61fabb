from collections import Counter, defaultdict

import numpy as np
import xxhash
from edge import empty, frame

from sharemill.llm import sharding


def test_rows_law_slots_and_sizes(spark, sf):
    docs = frame(spark, sf)
    got = sharding.assign(docs, 24).collect()
    assert len(got) == docs.count() and {r.law for r in got} == {"rows"}
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    import zlib

    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.assign(empty(spark), 24).count() == 0


def test_a_row_repeated_many_times_is_spread(spark):
    docs = spark.range(3000).selectExpr("7L as doc_id", "'same' as text")
    counts = Counter(r.shard for r in sharding.assign(docs, 24).collect())
    assert len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 1


def brute(rows, n_shards):
    """Keys walk the ring one by one: own cells first in ring order, then the overflow, clockwise."""
    size = 1 << sharding.RING_BITS
    owner = {}
    for shard in range(n_shards):
        for v in range(sharding.VNODES):
            owner.setdefault(xxhash.xxh64_intdigest(f"{shard}/{v}".encode(), 42) >> (64 - sharding.RING_BITS), shard)
    places = sorted(owner)
    of_cell = lambda c: owner[min((p for p in places if p >= c), default=places[0])]
    room = {s: len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)}
    cells = defaultdict(list)
    for cell, *key in rows:
        cells[cell].append(tuple(key))
    out, over = [], []
    for cell in sorted(cells):
        s = of_cell(cell)
        for key in sorted(cells[cell]):
            if room[s]:
                room[s] -= 1
                out.append((*key, s))
            else:
                over.append((cell, key))
    for cell, key in over:
        at = cell
        while not room[of_cell(at)]:
            at = next((p for p in places if p >= at), -1) + 1 if at <= places[-1] else 0
            at %= size
        room[of_cell(at)] -= 1
        out.append((*key, of_cell(at)))
    return Counter(out)


def test_rows_walk_the_ring(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.range(40).selectExpr("-7L as doc_id", "'same' as text"))
    cell = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - sharding.RING_BITS)
    rows = [tuple(r) for r in docs.select(cell, "doc_id", F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 8).cast("long")).collect()]
    got = Counter((r.doc_id, r.text_crc32, r["size"], r.shard) for r in sharding.assign(docs, 24).collect())
    assert got == brute(rows, 24)


def test_growing_the_ring_moves_little():
    assert set(np.unique(sharding.ring(25)[sharding.ring(24) != sharding.ring(25)])) == {24}
    counts = np.random.default_rng(0).poisson(20, 1 << sharding.RING_BITS)
    assert sharding.moved(counts, 24, 25) < 0.08
