"""Queries over whole tables against brute force, on a table whose ids lie beyond any subset."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from sharemill.operators import model
from sharemill.plans import algebra_queries as A
from sharemill.plans.registry import P, QUERIES, S

N, M = 130, 64


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    rows = [(40 + k, k % 10, [float(v) for v in rng.normal(0, 0.2, M)]) for k in range(N)]
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def table(spark, folder):
    """(vec_id, label, x) as Python's integers, rounded to fixed point from the stored floats."""
    out = [(r.vec_id, r.label, [int(np.sign(v)) * int(abs(v) * S + 0.5) for v in r.embedding]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    return sorted(out)


def near(v, d):
    return (1 if v >= 0 else -1) * ((2 * abs(v) + d) // (2 * d))


def got(spark, folder, name, *keys):
    rows = QUERIES[name](spark, folder).collect()
    out = {tuple(r[k] for k in keys): r.y for r in rows}
    assert len(out) == len(rows)
    return out


def test_products_take_every_vector_and_component(spark, folder, table):
    x = np.array([r[2] for r in table], dtype=object)
    gram = x.T @ x
    assert got(spark, folder, "matmul_raw", "i", "j") == {(i, j): gram[i, j] % P for i in range(M) for j in range(M)}
    assert got(spark, folder, "outer_product", "vec_id", "i", "j") == {(v, i, j): near(r[i] * r[j], S) for v, _, r in table for i in range(M) for j in range(M)}


def test_matrices_take_every_vector_and_component(spark, folder, table):
    cells = {(v, j): y for v, _, r in table for j, y in enumerate(r)}
    assert got(spark, folder, "transpose", "j", "i") == {k: y % P for k, y in cells.items()}
    assert got(spark, folder, "matrix_add", "i", "j") == {k: 2 * y % P for k, y in cells.items()}
    assert got(spark, folder, "matrix_scale", "i", "j") == {k: 777 * y % P for k, y in cells.items()}


def test_gradients_sum_over_every_row(spark, folder, table):
    got_g = got(spark, folder, "mlp_gradients", "layer", "i", "j")
    probs = {r.vec_id: r.p for r in A.probabilities(spark, folder).select("vec_id", "p").collect()}
    w = A.W
    want = dict.fromkeys([(n, i, j) for n, i, j, _ in w.rows()], 0)
    for v, label, x in table:
        z1 = [near(sum(a * b for a, b in zip(x, row, strict=True)), S) for row in w.w1]
        a1 = [max(z, 0) for z in z1]
        d2 = [q - (S if c == label else 0) for c, q in enumerate(probs[v])]
        da = [near(sum(g * w.w2[c][j] for c, g in enumerate(d2)), S) for j in range(len(w.w1))]
        d1 = [g if z > 0 else 0 for g, z in zip(da, z1, strict=True)]
        for layer, d, a in (("1", d1, x), ("2", d2, a1)):
            for i, g in enumerate(d):
                want["b" + layer, i, 0] += g
                for j, y in enumerate(a):
                    want["w" + layer, i, j] += near(g * y, S)
    assert got_g == want
    step = {(n, i, j): v - near(want[n, i, j] * round(0.05 * S), S * N) for n, i, j, v in w.rows()}
    assert got(spark, folder, "mlp_sgd_step", "layer", "i", "j") == step
    assert model.step(w, [{"layer": n, "i": i, "j": j, "y": y} for (n, i, j), y in want.items()], round(0.05 * S), S, N).w1[3][5] == step["w1", 3, 5]


def test_every_customer_has_a_status(spark, sf):
    keys = sorted(r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect())
    rows = QUERIES["kvs_get_batch"](spark, sf).collect()
    assert sorted(r.key for r in rows) == keys and all(r.status in ("MISSING", "STALE", "OK") for r in rows)


def test_every_batch_has_a_tag_of_its_real_ids(spark, sf):
    ids = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        ids[r.l_orderkey].add(r.l_partkey)
    want = {k: hashlib.sha256(("v1:" + ",".join(map(str, sorted(v)))).encode()).hexdigest()[:16] for k, v in ids.items()}
    assert {r.batch: r.tag for r in QUERIES["batch_tag"](spark, sf).collect()} == want
