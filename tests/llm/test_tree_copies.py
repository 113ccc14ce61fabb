"""What the vantage-point trees make grows with their fingerprints, and no pair is lost where they are dense."""

import numpy as np
import pytest

from sharemill.llm import simhash as S
from sharemill.llm.components import connected_components


def table(spark, fps):
    return spark.createDataFrame([(int(x),) for x in np.unique(fps).view(np.int64)], "fp long")


def test_rows_of_shards_grow_with_the_table(spark, monkeypatch):
    """Five times the fingerprints make five times the rows; border copies made over eight times as many."""
    monkeypatch.setattr(S, "SHARD", 64)
    fps = np.random.default_rng(3).integers(0, 1 << 64, 10_000, np.uint64)
    made = [S.shards(table(spark, fps[:n]), 2) for n in (2_000, 10_000)]
    assert [m.count() for m in made] == [6_000, 30_000]
    assert all(m.groupBy("shard").count().agg({"count": "max"}).first()[0] <= 64 for m in made)


@pytest.mark.parametrize(("bits", "n"), [(12, 1500), (20, 2500)])
def test_dense_fingerprints_lose_no_pair(spark, monkeypatch, bits, n):
    """Fingerprints that differ in a few bits only, so that all agree in a part of them, are parted by the others."""
    monkeypatch.setattr(S, "SHARD", 32)
    rng = np.random.default_rng(bits)
    places = np.uint64(1) << rng.permutation(64)[:bits].astype(np.uint64)
    fps = np.unique((rng.integers(0, 2, (n, bits)).astype(np.uint64) * places).sum(axis=1, dtype=np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    df, ids = table(spark, fps), fps.view(np.int64).tolist()
    rows = S.shards(df, 2).collect()
    met, sizes = {x: set() for x in ids}, {}
    for r in rows:
        met[r.fp].add(r.shard)
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert (i < j).sum() > 100 and all(met[ids[a]] & met[ids[b]] for a, b in zip(i.tolist(), j.tolist(), strict=True))
    assert max(sizes.values()) <= 32 and len(rows) <= 3**5 * len(fps)
    low = list(range(len(ids)))
    while True:  # the least number reachable
        new = np.minimum.reduceat(np.array(low)[j], np.flatnonzero(np.r_[True, np.diff(i) > 0])).tolist()
        if new == low:
            break
        low = new
    got = {r.node: r.component for r in connected_components(S.links(df)).collect()}
    names = {}
    for k, x in enumerate(ids):
        names.setdefault(low[k], set()).add(got.get(x, x))
    assert all(len(v) == 1 for v in names.values()) and len({min(v) for v in names.values()}) == len(names)
