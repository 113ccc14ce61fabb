from collections import Counter

import numpy as np
import pytest
import xxhash
from edge import frame
from pyspark.sql import functions as F

from sharemill.llm import simhash as S
from sharemill.llm.components import connected_components
from sharemill.llm.store import with_value

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute(rows, radius=2):
    fps = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, f"{f:016x}", least[find(k)]) for k, (i, f) in enumerate(fps))


def test_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = rows[3][1]
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, "One two"), (5004, "one TWO"), (5005, base), (5006, base + " x"), (5007, "w " * 30000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = sorted(map(tuple, S.near_duplicates(df).collect()))
    assert got == brute(rows)


def test_empty_and_repeated(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = S.near_duplicates(spark.createDataFrame([(7, "a b c", "", 0), (7, "a b c", "", 0), (9, "a b c", "", 0)], SCHEMA)).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {7}


def test_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
    near = fps[:2000] ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64))
    all_ = np.concatenate([fps, near])
    at, mu = S.plant(np.sort(all_), 5, 2)
    idx, shard = S.route(all_, at, mu, 2)
    by = {}
    for i, s in zip(idx.tolist(), shard.tolist()):
        by.setdefault(i, set()).add(s)
    assert len(set(shard.tolist())) > 8
    assert all(by[i] & by[6000 + i] for i in range(2000))


@pytest.mark.parametrize("shard", [4, 16, 64])
def test_links_at_any_shard_size(spark, monkeypatch, shard):
    """Random values, chains of near ones, and a ball whose values can't be told apart by distance."""
    monkeypatch.setattr(S, "SHARD", shard)
    monkeypatch.setattr(S, "ROWS_PER_TASK", 300)
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 200)).astype(np.uint64)
    ball = np.uint64(5 << 40) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    all_ = np.unique(np.concatenate([fps, fps[:200] ^ flips[0] ^ flips[1], fps[:200] ^ flips[2], ball]))
    df = spark.createDataFrame([(int(x),) for x in all_.view(np.int64)], "fp long")
    close = np.bitwise_count(all_[:, None] ^ all_[None, :]) <= 2
    met = {x: set() for x in all_.view(np.int64).tolist()}
    for r in S.shards(df, 2).collect():
        met[r.fp].add(r.shard)
    pairs = [(int(all_.view(np.int64)[i]), int(all_.view(np.int64)[j])) for i, j in zip(*np.nonzero(close), strict=True) if i < j]
    assert len(pairs) > 2000 and all(met[a] & met[b] for a, b in pairs)
    root = {x: x for x in met}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected_components(S.links(df)).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}


def test_edge_rows_and_null_ids(spark):
    df = frame(spark).withColumn("text", F.when(F.col("doc_id").isNull(), F.lit("Same text here.\nTwice.")).otherwise(F.col("text")))
    got = Counter((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect())
    assert got[(None, 6)] == 1 and got[(6, 6)] == 2 and got[(7, 6)] == 1 and got[(1, 0)] == got[(2, 0)] == 1
    alone = S.near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")).collect()
    assert [r.component_id for r in alone] == [None, None]


def test_rows_of_a_hot_key_keep_their_value(spark):
    rows = spark.range(4000).selectExpr("id", "case when id < 3000 then 7 else id end as fp")
    table = rows.groupBy("fp").agg(F.count("*").alias("n")).withColumn("v", F.col("fp") * 2)
    got = with_value(rows, table, "fp", F.col("id"))
    assert got.columns == ["fp", "id", "v"] and got.count() == 4000 and not got.where("v <> fp * 2").count()
