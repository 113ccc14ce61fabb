"""Frames in chunks, vectors as bytes, archives of arrays: round trips and damaged input."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharemill.operators import frames, model
from sharemill.sources import arrays

ROWS = [(1, k, json.dumps({"k": k, "é": "ü"}), bytes([k % 256]) * (k * 37 % 500)) for k in range(60)] + [(2, 0, "", b""), (3, 0, "x", b"y" * 5000), (4, 0, "{}", b"")]


def streams(spark, rows, size):
    df = spark.createDataFrame(rows, "stream long, seq long, header string, payload binary").repartition(3)
    return frames.chunked(df.select("stream", "seq", frames.frame(F.col("header"), F.col("payload")).alias("frame")), size)


@pytest.mark.parametrize("size", [1, 7, 1024, 1 << 20])
def test_frames_cross_chunks(spark, size):
    chunks = streams(spark, ROWS, size)
    got = chunks.collect()
    for s in (1, 2, 3, 4):
        own = sorted((r.seq, bytes(r.chunk)) for r in got if r.stream == s)
        want = b"".join(struct.pack(">II", len(h.encode()), len(p)) + h.encode() + p for t, _, h, p in ROWS if t == s)
        assert b"".join(c for _, c in own) == want and [k for k, _ in own] == list(range(len(own))) and all(len(c) == size for _, c in own[:-1])
    back = sorted((r.stream, r.place, r.header, bytes(r.payload)) for r in frames.split(chunks).collect() if r.error is None)
    assert back == sorted(ROWS)


def test_damaged_streams_are_rows_with_an_error(spark):
    good = struct.pack(">II", 2, 3) + b"{}" + b"abc"
    bad = {1: good + good[:-1], 2: good + struct.pack(">II", 1 << 30, 5) + b"zz" + good, 3: struct.pack(">II", 2, 0) + b"\xff\xfe" + good, 4: good, 5: b"\x00"}
    df = spark.createDataFrame([(s, k, raw[k : k + 4]) for s, raw in bad.items() for k in range(0, len(raw), 4)] + [(6, 0, None)], "stream long, seq long, chunk binary")
    got = sorted((r.stream, r.place, r.error) for r in frames.split(df, 1000).collect() if r.error)
    assert [(s, p) for s, p, _ in got] == [(1, 1), (2, 1), (3, 0), (5, 0)] and "1073741829" in got[1][2]
    assert {(r.stream, r.place) for r in frames.split(df, 1000).where("error is null").collect()} == {(1, 0), (2, 0), (4, 0)}
    assert frames.split(df.limit(0)).count() == 0


def test_vectors_as_bytes(spark):
    rows = [(1, [0, 1, 4294967295]), (2, [0, 4294967296, (1 << 61) - 2]), (3, []), (4, [7])]
    own = spark.createDataFrame(rows, "id long, v array<long>").withColumn("w", frames.width(F.col("v"))).withColumn("raw", frames.vector_bytes(F.col("v"), F.col("w")))
    for r in own.withColumn("back", frames.vector_of(F.col("raw"), F.col("w"))).collect():
        assert bytes(r.raw) == struct.pack("<" + ("Q" if r.w == 8 else "I") * len(r.v), *r.v) and r.back == r.v and r.w == (8 if r.id == 2 else 4)
    assert own.select(frames.vector_of(F.lit(b"abc"), F.lit(4)).alias("x")).first().x is None


def test_archives_of_arrays(spark, tmp_path):
    r = np.random.default_rng(3)
    own = {"x_train": r.integers(0, 256, (9000, 4, 5), dtype=np.uint8), "y_train": r.integers(0, 10, 9000), "x_test": r.integers(0, 256, (7, 4, 5), dtype=np.uint8), "y_test": r.integers(0, 10, 7)}
    arrays.write_arrays(spark, f"file://{tmp_path}/digits.npz", **own)
    with np.load(tmp_path / "digits.npz") as held:
        assert all((held[k] == v).all() for k, v in own.items())
    got = {(x.split, x.id): x for x in arrays.read_digits(spark, f"file://{tmp_path}/digits.npz", train=5000).collect()}
    assert len(got) == 5007
    for (s, i), x in got.items():
        assert np.allclose(x.x, own[f"x_{s}"][i].ravel() / 255) and x.label == own[f"y_{s}"][i] and [k for k, v in enumerate(x.y) if v] == [x.label]
    w = model.Weights.start(6, 4, 3, 1 << 16)
    arrays.write_weights(spark, f"file://{tmp_path}/w.npz", w, 1 << 16)
    back = arrays.read_weights(spark, f"file://{tmp_path}/w.npz")
    assert all((np.rint(back[n] * (1 << 16)).astype(int) == np.array(getattr(w, n))).all() for n in arrays.LAYERS)
    with pytest.raises(Exception, match="no arrays"):
        arrays.read_arrays(spark, f"file://{tmp_path}/w.npz", ["x_train"]).count()
