"""Stores, membership, logs, readers and writers on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sharemill.operators import kv, membership, metrics, model
from sharemill.sources import tables


def test_versions(spark):
    rows = [("a", 0, 1, "x"), ("a", 1, 3, "y"), ("a", 2, 3, "late"), ("a", 3, 2, "old"), ("b", 4, 0, "z")]
    log = spark.createDataFrame(rows, "key string, seq long, version long, value string")
    assert [r.accepted for r in kv.accepted(log, ["key"], ["seq"]).orderBy("seq").collect()] == [True, True, False, False, True]
    now = kv.latest(log, ["key"], ["seq"])
    assert {tuple(r) for r in now.collect()} == {("a", 3, "y"), ("b", 0, "z")}
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {tuple(r) for r in kv.fresh(now, wanted, ["key"], 1).collect()} == {("a", 3, "y"), ("b", None, None), ("c", None, None)}


def test_compare_and_set_lets_one_writer_win(spark):
    rows = [("k", 0, 0, 1), ("k", 1, 0, 1), ("k", 2, 1, 2), ("k", 3, 2, 2), ("m", 4, 10, 11), ("m", 5, -1, 10), ("m", 6, 10, 11)]
    log = spark.createDataFrame(rows, "key string, seq long, expected long, version long")
    got = {r.seq: (r.success, r.current) for r in kv.compare_and_set(log, "key", ["seq"]).collect()}
    assert got == {0: (True, 1), 1: (False, 1), 2: (True, 2), 3: (False, 2), 4: (False, None), 5: (True, 10), 6: (True, 11)}


def test_quorum(spark):
    rows = [("k", n, n <= 3) for n in range(1, 6)] + [("m", n, n <= 2) for n in range(1, 6)]
    got = kv.quorum(spark.createDataFrame(rows, "key string, node_id int, accepted boolean"), ["key"], 5)
    assert {tuple(r) for r in got.collect()} == {("k", 3, True), ("m", 2, False)}


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def test_failures_and_timeline(spark):
    beats = spark.createDataFrame([(1, at(0)), (1, at(5)), (1, at(20)), (2, at(0)), (2, at(19))], "node long, ts timestamp_ntz")
    got = {(r.node, r.failed_at, r.recovered_at) for r in membership.failures(beats, "node", "ts", 6).collect()}
    assert got == {(1, at(11), at(20)), (2, at(6), at(19))}
    kinds = [(0, 1, "join"), (1, 2, "join"), (30, 1, "drop"), (31, 1, "drop"), (55, 2, "reshare_complete"), (56, 1, "join")]
    events = spark.createDataFrame([(k, at(h), n, kind) for k, (h, n, kind) in enumerate(kinds)], "id long, ts timestamp_ntz, node long, kind string")
    got = [(r.n_active, r.paused, r.epoch) for r in membership.timeline(events, "ts", "id", "node", "kind").orderBy("id").collect()]
    assert got == [(1, 0, 1), (2, 0, 2), (1, 1, 2), (1, 1, 2), (1, 0, 2), (2, 0, 3)]


def test_barriers(spark):
    rows = [("t", "a"), ("t", "b"), ("t", "b"), ("u", "a")]
    got = membership.barriers(spark.createDataFrame(rows, "tag string, sender string"), "tag", "sender", ["a", "b"])
    assert {tuple(r) for r in got.collect()} == {("t", "a,b", True), ("u", "a", False)}


def test_log_lines(spark, tmp_path):
    df = spark.createDataFrame([("node1", "fwd", 1.5)], "role string, phase string, s double")
    line = df.select(metrics.encode(F.col("role"), F.col("phase"), F.col("s"), bytes_total=F.lit(3000)).alias("line")).first().line
    assert line == "[BENCHMARK] role=node1 phase=fwd wall_sec=1.500000 bytes_total=3000"
    (tmp_path / "node_1.log").write_text(f"noise a=1\n{line}\n\n")
    (tmp_path / "other.txt").write_text(line)
    own = tables.log_lines(spark, str(tmp_path))
    got = [r.m for r in own.orderBy("line_no").select(metrics.parse(F.col("line")).alias("m")).collect()]
    assert got[0] is None and got[1]["bytes_total"] == "3000" and len(got) == 2
    again = spark.createDataFrame([(f"{line} phase=bwd",)], "line string").select(metrics.parse(F.col("line")).alias("m")).first().m
    assert again["phase"] == "bwd"


def test_topology_and_arguments(spark):
    entries = [{"party_id": 2, "host": "b", "port": 2}, {"party_id": 1, "host": "a", "port": 1}]
    got = {tuple(r) for r in tables.topology(spark, entries, own=1, listen=("0.0.0.0", 9)).collect()}
    assert got == {(1, "0.0.0.0", 9), (2, "b", 2)}
    with pytest.raises(ValueError):
        tables.topology(spark, [{"party_id": 2, "host": "b", "port": 2}])
    assert tables.config_to_args({"batch_size": 64, "quiet": True, "off": False, "none": None, "peer": [1, 2]}) == ["--batch-size", "64", "--quiet", "--peer", "1", "--peer", "2"]
    with pytest.raises(ValueError):
        tables.config_to_args({"a": {"b": 1}})


def test_images_and_weights(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.raw").write_bytes(bytes([0, 255] * 392))
    x = tables.raw_images(spark, str(tmp_path / "i")).first().x
    assert len(x) == 784 and x[:2] == [0.0, 1.0]
    (tmp_path / "i" / "b.raw").write_bytes(b"short")
    with pytest.raises(Exception, match="5 bytes"):
        tables.raw_images(spark, str(tmp_path / "i")).collect()
    w = model.Weights.start(6, 3, 2, 1 << 16)
    tables.write_weights(spark, w, str(tmp_path / "w"), 4, accuracy=0.5)
    assert tables.read_weights(spark, str(tmp_path / "w")) == w


def test_training_lowers_the_loss(spark):
    scale = 1 << 16
    rows = [(k, [scale if j == k % 2 else 0 for j in range(4)], k % 2) for k in range(64)]
    x = spark.createDataFrame(rows, "id long, x array<long>, label int")
    hits = lambda w: model.forward(x, w, scale).where(model.argmax(F.col("z2")) == F.col("label")).count()
    w = model.Weights.start(4, 3, 2, scale)
    assert hits(model.train(x, w, scale, 0.5, 32, 4)) >= max(hits(w), 32)
