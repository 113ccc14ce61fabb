"""What SQL can't say: training in doubles, readers and writers, and errors of the newer operators."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharemill.operators import division, kv, membership, model, packed, plain, recovery, sharing
from sharemill.plans.catalogue import QUERIES
from sharemill.sources import tables
from sharemill.spec import P61, FieldSpec


def test_training_in_doubles_is_a_loop_over_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 1, 6).tolist(), int(k % 3)) for k in range(70)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int").repartition(4)
    start = plain.he_start((6, 5, 3))
    got = plain.train(df, start, 0.1, 25, 3, clip=0.05, temperature=2.0, limit=4.0)
    w = {k: v.copy() for k, v in start.items()}
    for epoch in range(3):
        order = sorted(rows, key=lambda r: int(hashlib.sha256(f"{2026 + epoch}|{r[0]}".encode()).hexdigest()[:15], 16))  # noqa: B023
        for b in range(3):
            own = order[25 * b : 25 * b + 25]
            g = plain.batch_gradients(np.array([r[1] for r in own]), np.array([r[2] for r in own]), w, temperature=2.0, limit=4.0)
            for k in w:
                w[k] -= 0.1 * 0.95**epoch * np.clip(g[k] / len(own), -0.05, 0.05)
    assert all(np.allclose(got[k], w[k], atol=1e-12) for k in w)
    same = plain.train(df.limit(0), start, 0.1, 25, 1)
    assert all((same[k] == start[k]).all() for k in start)


def test_gradients_in_doubles_match_differences():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(0, 1, (9, 4)), rng.integers(0, 3, 9), plain.he_start((4, 5, 3))

    def loss(w):
        z = np.maximum(0, x @ w["w1"].T + w["b1"]) @ w["w2"].T + w["b2"]
        return -np.log((np.exp(z) / np.exp(z).sum(axis=1, keepdims=True))[np.arange(9), y]).sum()

    g = plain.batch_gradients(x, y, w)
    for k in w:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(g[k][at], rel=1e-4)
    squares = plain.batch_gradients(x, y, w, mode="mse")
    assert all(np.isfinite(v).all() for v in squares.values())


def test_plain_train_learns_a_model_of_its_shape(spark, sf):
    rows = QUERIES["plain_train"](spark, sf).collect()
    assert len(rows) == 64 * 8 + 8 + 8 * 10 + 10 and all(np.isfinite(r.v) for r in rows)


def test_stable_softmax(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, -1000.0],), ([0.0, 0.0, 0.0],)], "z array<double>")
    a, b = (r.p for r in df.select(plain.softmax_stable(F.col("z"), 3).alias("p")).collect())
    assert a == pytest.approx([0.5, 0.5, 0.0]) and b == pytest.approx([1 / 3] * 3)


def test_grey_images_of_any_size(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# made here\n4 2\n255\n" + bytes([0, 85, 170, 255] * 2))
    (tmp_path / "b.pgm").write_bytes(b"P5 28 28 255\n" + bytes(range(28)) * 28)
    got = {r.path[-5:]: np.array(r.x).reshape(28, 28) for r in tables.grey_images(spark, str(tmp_path)).collect()}
    assert got["b.pgm"][3] == pytest.approx(np.arange(28) / 255)  # its own size: as it is
    assert got["a.pgm"][0][0] == 0 and got["a.pgm"][5][-1] == 1 and (np.diff(got["a.pgm"][9]) >= 0).all()
    (tmp_path / "c.pgm").write_bytes(b"P2 1 1 255 7")
    with pytest.raises(Exception, match="not an 8-bit grey map"):
        tables.grey_images(spark, str(tmp_path / "c.pgm")).collect()


def test_indices_and_runs(spark, tmp_path):
    rows = spark.range(50).withColumnRenamed("id", "k")
    own = tables.subset(rows, "k", 7, 9)
    tables.write_indices(own, str(tmp_path / "idx"))
    assert sorted(own.collect()) == sorted(tables.read_indices(spark, str(tmp_path / "idx"), "k").collect()) and own.count() == 7
    assert tables.subset(rows, "k", 99, 9).count() == 50
    assert sorted(r.k for r in tables.read_indices(spark, str(tmp_path / "none"), "k", rows, 5).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(FileNotFoundError):
        tables.read_indices(spark, str(tmp_path / "none"), "k")
    for loss in (0.5, 0.25):
        tables.append_run(spark.createDataFrame([("run", loss)], "id string, loss double"), str(tmp_path / "runs"))
    assert sorted(r.loss for r in spark.read.option("header", True).csv(str(tmp_path / "runs")).collect()) == ["0.25", "0.5"]
    with pytest.raises(Exception, match="2 values, not 3"):
        spark.createDataFrame([([1, 2],)], "v array<int>").select(tables.checked(F.col("v"), 3)).collect()


@pytest.mark.parametrize("k", [1, 2, 3])
def test_vectors_of_any_length(spark, k):
    spec = FieldSpec(n=6, t=2, k=k)
    rows = [(n, [(7 * n + j) % P61 for j in range(n)]) for n in range(8)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, x array<long>")
    shares = packed.share_vector(df, "x", ["id"], spec)
    want = {(n, j): v for n, x in rows for j, v in enumerate(x or [])}
    assert {(r.id, r.idx): r.secret for r in packed.reconstruct_vector(shares, ["id"], spec).collect()} == want
    lanes = packed.to_lanes(shares, ["id"], spec)
    back = sharing.reconstruct(lanes, ["id", "idx"], spec)
    assert {(r.id, r.idx): r.secret for r in back.collect()} == want


def test_committees_that_share_too_few_members():
    assert recovery.senders([1, 2, 3], [2, 3, 9], 1) == [2, 3]
    with pytest.raises(ValueError):
        recovery.senders([1, 2], [2, 3], 1)


def test_inverses_of_zero_are_null(spark):
    df = spark.createDataFrame([(1, 0), (2, 5), (3, None)], "id long, v long")
    got = {r.id: r.inverse for r in division.inverses(df, "v", P61).collect()}
    assert got == {1: None, 2: pow(5, -1, P61), 3: None} and df.columns == ["id", "v"]


def test_a_write_that_expects_nothing_changes_nothing(spark):
    log = spark.createDataFrame([("a", 1, 0, 1), ("a", 2, None, 2), ("a", 3, 1, 2)], "k string, o long, expected long, version long")
    got = [(r.success, r.current) for r in kv.compare_and_set(log, "k", ["o"]).orderBy("o").collect()]
    assert got == [(True, 1), (False, 1), (True, 2)]


def test_pieces_without_a_query(spark):
    spec = FieldSpec()
    df = spark.createDataFrame([(1, 3.25), (2, -1.5)], "id long, v double")
    from sharemill.functions import field as fd

    assert [r.v for r in df.select(fd.decode(fd.encode(F.col("v"), spec), spec).alias("v")).collect()] == [3.25, -1.5]
    assert spark.range(1).withColumn("label", F.lit(2)).select(tables.one_hot("label", 4)).first()[0] == [0, 0, 1, 0]
    assert tables.share_bytes(spark.createDataFrame([(1, 5), (1, 1 << 40), (2, 7)], "k long, v long"), ["k"], "v").orderBy("k").collect()[0].bytes == 16
    own = sharing.share(spark.createDataFrame([(1, 77)], "id long, s long"), "s", ["id"], spec)
    same = sharing.reshare(own, ["id"], spec, [1, 2, 3], [3, 2, 1])
    assert sharing.reconstruct(same, ["id"], spec).first().secret == 77 and sorted(r.y for r in same.collect()) != sorted(r.y for r in own.collect())


@pytest.mark.parametrize("name", ["membership_timeline", "state_transitions", "recovery_events"])
def test_spans_of_time_do_not_change_results(spark, sf, monkeypatch, name):
    whole = sorted(QUERIES[name](spark, sf).collect())
    monkeypatch.setattr(membership, "SPAN_ROWS", 60)
    assert sorted(QUERIES[name](spark, sf).collect()) == whole


def test_spans_rise_with_time(spark, sf, monkeypatch):
    monkeypatch.setattr(membership, "SPAN_ROWS", 50)
    df = tables.table(spark, sf, "events")
    rows = df.select("ts", membership.spans(df, "ts").alias("s")).orderBy("ts").collect()
    assert [r.s for r in rows] == sorted(r.s for r in rows) and len({r.s for r in rows}) >= 15
    assert df.limit(0).select(membership.spans(df.limit(0), "ts")).count() == 0


def near(v, d):
    return (1 if v >= 0 else -1) * ((2 * abs(v) + d) // (2 * d))


def loop_gradients(rows, w, scale):
    """Python's integers, a row and a weight at a time."""
    out = {}

    def add(layer, i, j, v):
        out[layer, i, j] = out.get((layer, i, j), 0) + v

    for x, label in rows:
        z1 = [near(sum(a * b for a, b in zip(r, x, strict=True)), scale) + b1 for r, b1 in zip(w.w1, w.b1, strict=True)]
        a1 = [max(v, 0) for v in z1]
        z2 = [near(sum(a * b for a, b in zip(r, a1, strict=True)), scale) + b2 for r, b2 in zip(w.w2, w.b2, strict=True)]
        c = [max(min(v - max(z2), 4 * scale), -4 * scale) for v in z2]
        e = []
        for v in c:
            square, half = near(near(v * v, scale), 12), near(v, 2)
            e.append(max(1, min(55 * scale, near((square + half + scale) * scale, square - half + scale))))
        p = [max(0, min(scale, near(v * scale, sum(e)))) for v in e]
        p[p.index(max(p))] += scale - sum(p)
        d2 = [v - (scale if k == label else 0) for k, v in enumerate(p)]
        d1 = [near(sum(d2[k] * w.w2[k][j] for k in range(len(d2))), scale) if z1[j] > 0 else 0 for j in range(len(z1))]
        for layer, d, a in (("w1", d1, x), ("w2", d2, a1)):
            for i, g in enumerate(d):
                for j, v in enumerate(a):
                    add(layer, i, j, near(g * v, scale))
        for layer, d in (("b1", d1), ("b2", d2)):
            for i, g in enumerate(d):
                add(layer, i, 0, g)
    return out


def test_training_in_fixed_point_is_a_loop_over_batches(spark):
    scale, rng = 1 << 16, np.random.default_rng(8)
    rows = [(k, [int(v) for v in rng.integers(-scale, scale, 5)], int(k % 3)) for k in range(41)]
    start = model.Weights.start(5, 4, 3, scale)
    got = model.train(spark.createDataFrame(rows, "id long, x array<long>, label int").repartition(3), start, scale, 0.05, 16, 2)
    w = start
    for epoch in range(2):
        order = sorted(rows, key=lambda r: int(hashlib.sha256(f"{2026 + epoch}|{r[0]}".encode()).hexdigest()[:15], 16))  # noqa: B023
        rate = round(0.05 * 0.95**epoch * scale)
        for b in range(3):
            own = order[16 * b : 16 * b + 16]  # 16, 16 and 9 rows
            g = loop_gradients([(x, label) for k, x, label in own], w, scale)
            take = lambda n, i, j, v: v - near(rate * g[n, i, j], scale * len(own))  # noqa: B023, E731
            w = model.Weights(
                [[take("w1", i, j, v) for j, v in enumerate(r)] for i, r in enumerate(w.w1)], [take("b1", i, 0, v) for i, v in enumerate(w.b1)],
                [[take("w2", i, j, v) for j, v in enumerate(r)] for i, r in enumerate(w.w2)], [take("b2", i, 0, v) for i, v in enumerate(w.b2)],
            )
    assert got == w and got != start


def test_a_step_in_doubles_is_shared_and_opened_again(spark, sf):
    own = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")
    w = plain.train(own, plain.he_start((64, 8, 10)), 0.05, own.count(), 1)
    want = {(n, i, j): round(v * (1 << 16)) for n, i, j, v in plain.rows(w)}  # both round halves to even
    got = {(r.layer, r.i, r.j): r.y for r in QUERIES["hybrid_update"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) <= 1 for k, v in want.items())
