"""Stored batches, and runs that stop and go on."""

import hashlib

import pytest

from sharemill.operators import model
from sharemill.sources import batches
from sharemill.sources.tables import vectors


def turn(seed, key):
    return int(hashlib.sha256(f"{seed}|{key}".encode()).hexdigest()[:15], 16)


def test_batches_are_slices_of_the_keyed_order(spark, tmp_path):
    df = spark.range(1000).selectExpr("id * 3 as id", "id % 7 as v").repartition(9)
    path = batches.cluster(df, f"file://{tmp_path}/a", 64, 5, 2)
    rows = spark.read.parquet(path).collect()
    want = sorted((3 * k for k in range(1000)), key=lambda k: turn(7, k))
    assert [r.id for r in sorted(rows, key=lambda r: (r.batch, r.pos))] == want
    assert [sum(r.batch == b for r in rows) for b in range(16)] == [64] * 15 + [40]
    before = (tmp_path / "a/epoch=00002/_SUCCESS").stat().st_mtime_ns
    assert batches.cluster(df, f"file://{tmp_path}/a", 64, 5, 2) == path  # not written again
    assert (tmp_path / "a/epoch=00002/_SUCCESS").stat().st_mtime_ns == before
    assert spark.read.schema("id long").parquet(batches.cluster(df.limit(0), f"file://{tmp_path}/none", 64, 5, 0)).count() == 0


def read_rows(df):
    """Rows that the scan handed on."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        p = todo.pop()
        if "AdaptiveSparkPlan" in p.nodeName():
            todo.append(p.executedPlan())
            continue
        if p.nodeName().startswith("Scan parquet"):
            total += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        todo.extend(kids.apply(k) for k in range(kids.size()))
    return total


def test_a_step_reads_little_more_than_its_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "PART_ROWS", 2048)
    monkeypatch.setattr(batches, "GROUP_BYTES", 64 << 10)
    df = spark.range(20_000).selectExpr("id", "transform(sequence(1, 64), k -> hash(id, k)) as x")
    path = batches.cluster(df, f"file://{tmp_path}", 128, 1, 0)
    schema = spark.read.parquet(path).drop("part").schema
    own = batches.read_batch(spark, path, 37, 128, schema)
    assert own.count() == 128 and read_rows(batches.read_batch(spark, path, 37, 128, schema)) <= 1024


def test_a_run_that_stops_ends_with_the_same_weights(spark, sf, tmp_path):
    own = vectors(spark, sf, 1 << 16).withColumnRenamed("vec_id", "id")
    start = model.Weights.start(64, 4, 10, 1 << 16)
    whole = model.train(own, start, 1 << 16, 0.05, 200, 2)
    base = f"file://{tmp_path}/run"
    how = (own, start, 1 << 16, 0.05, 200, 2)
    with pytest.raises(model.Paused):
        model.train(*how, base=base, stop_after=2)
    assert batches.last_commit(spark, base)[0] == 2
    # what was being written when a run died doesn't count
    (tmp_path / "run/weights/v=000000003").mkdir()
    tried = []

    def pauses(step):
        tried.append(step)
        return {3: ("dropout", 5), 4: ("dropout", 2)}.get(step)

    with pytest.raises(model.Paused, match="step 4"):  # 5 members are safe, so step 3 goes on; 2 aren't
        model.train(*how, base=base, pauses=pauses)
    assert tried == [2, 3, 4] and batches.last_commit(spark, base)[0] == 4
    assert model.train(*how, base=base) == whole != start
    assert model.train(*how, base=base) == whole  # nothing is left to do
    assert len(list((tmp_path / "run/weights").glob("v=*/_SUCCESS"))) <= batches.KEPT
    assert model.train(own.limit(0), start, 1 << 16, 0.05, 200, 2) == start
    assert not model.recovered("other", 9) and model.recovered("rejoin", 3)


def test_resumed_equals_whole(spark, sf):
    from sharemill.plans.catalogue import QUERIES

    key = lambda r: (r.layer, r.i, r.j)
    a, b = (sorted(QUERIES[n](spark, sf).collect(), key=key) for n in ("mlp_train_epochs", "mlp_train_resumed"))
    assert a == b


def test_stretches_equal_steps_of_a_job_each(spark, sf, monkeypatch):
    import numpy as np

    from sharemill.operators import plain

    own = vectors(spark, sf, 1 << 16).withColumnRenamed("vec_id", "id")
    start = model.Weights.start(64, 4, 10, 1 << 16)
    doubles = own.selectExpr("id", "transform(x, v -> v / 65536D) as x", "label")
    jobs, real = [], batches.stretch
    monkeypatch.setattr(batches, "stretch", lambda *a: jobs.append(a[2:4]) or real(*a))
    got, floats = model.train(own, start, 1 << 16, 0.05, 64, 2), plain.train(doubles, plain.he_start((64, 4, 10)), 0.05, 64, 2, clip=1.0)
    n = -(-own.count() // 64)
    assert jobs == [(0, n)] * 4 and n > 2  # a job an epoch, not one a step
    monkeypatch.setattr(batches, "STRETCH_ROWS", 128)
    jobs.clear()
    assert model.train(own, start, 1 << 16, 0.05, 64, 1) != start and len(jobs) == -(-n // 2)
    monkeypatch.setattr(batches, "STRETCH_ROWS", 1)  # each slice over many tasks
    assert model.train(own, start, 1 << 16, 0.05, 64, 2) == got
    single = plain.train(doubles, plain.he_start((64, 4, 10)), 0.05, 64, 2, clip=1.0)
    assert all(np.allclose(single[k], floats[k], rtol=0, atol=1e-12) for k in single)
