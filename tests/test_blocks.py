"""Products of matrices by blocks and matrix triples, against plain integers."""

import numpy as np
import pytest

from sharemill.functions import limbs
from sharemill.operators import blocks
from sharemill.plans.catalogue import QUERIES
from sharemill.spec import P61, FieldSpec


@pytest.mark.parametrize("p", [P61, (1 << 32) - 5, (1 << 31) - 1, 1009])
def test_limbs_are_exact(p):
    r = np.random.default_rng(p % 97)
    for shape in ((3, 4, 5), (1, 5000, 2), (7, 1, 7), (2, 0, 3)):
        a, b = r.integers(0, p, shape[:2], dtype=np.uint64), r.integers(0, p, shape[1:], dtype=np.uint64)
        if a.size:
            a.flat[0], b.flat[0] = p - 1, p - 1
        want = (a.astype(object) @ b.astype(object)) % p if shape[1] else np.zeros((shape[0], shape[2]), object)
        assert (limbs.matmul(a, b, p).astype(object) == want).all()
        assert (limbs.sub(a, a, p) == 0).all() and (limbs.scaled(a, p - 1, p).astype(object) == (a.astype(object) * (p - 1)) % p).all()


def test_worst_entries_are_exact():
    a = np.full((2, limbs.MOST_TERMS), P61 - 1, np.uint64)
    assert (limbs.matmul(a, a.T, P61) == limbs.MOST_TERMS % P61).all()


def frames(spark, n=1300, wide=70, narrow=3, seed=2, left=5, right=700):
    r = np.random.default_rng(seed)
    x, y = r.integers(-(1 << 40), 1 << 40, (n, wide)), r.integers(-(1 << 40), 1 << 40, (n, narrow))
    x[left] = y[right % n] = 0
    make = lambda m, skip: spark.createDataFrame([(k, m[k].tolist()) for k in range(n) if k not in skip], "k long, v array<long>").repartition(5)
    return x, y, make(x, {left}), make(y, {right % n})


@pytest.mark.parametrize("spec", [FieldSpec(), FieldSpec(n=5, t=2), FieldSpec(p=(1 << 32) - 5, t=0)])
def test_shared_product(spark, spec, monkeypatch):
    monkeypatch.setattr(blocks, "MERGE", 2)
    monkeypatch.setattr(blocks, "ROWS", 128)
    x, y, xs, ys = frames(spark)
    left = blocks.shared(blocks.of_rows(xs, "k", "v", 70, spec, transposed=True), "x", spec)
    right = blocks.shared(blocks.of_rows(ys, "k", "v", 3, spec), "y", spec)
    out = blocks.product(left, right, spec)
    want = (x.T.astype(object) @ y.astype(object)) % spec.p
    got = {(r.i, r.j): r.y for r in blocks.cells(blocks.opened(out, spec)).collect()}
    assert got == {(i, j): want[i, j] for i in range(70) for j in range(3)}
    if spec.t:
        one = {(r.bi, r.bj, r.party): bytes(r.m) for r in out.collect()}
        assert len(set(one.values())) == len(one) == 2 * spec.n  # shares of parties differ
        plain = {(r.bi, r.bj): bytes(r.m) for r in blocks.opened(blocks.shared(blocks.of_rows(ys, "k", "v", 3, spec), "y", spec), spec).collect()}
        assert plain == {(r.bi, r.bj): bytes(r.m) for r in blocks.of_rows(ys, "k", "v", 3, spec).collect()}


def test_rows_times_a_matrix(spark):
    """Blocks that lie on, as wide as long: (n by 70)(70 by n') has several blocks of the result."""
    spec = FieldSpec()
    x, y, xs, _ = frames(spark, n=600)
    small = spark.createDataFrame([(k, [int(v) for v in x[k]]) for k in range(64)], "k long, v array<long>")
    a = blocks.of_rows(small, "k", "v", 70, spec, transposed=True)  # 70 by 64
    b = blocks.of_rows(small, "k", "v", 70, spec)
    got = {(r.i, r.j): r.y for r in blocks.cells(blocks.plain_product(a, b, spec)).collect()}
    own = x[:64].astype(object)
    want = (own.T @ own) % spec.p
    assert got == {(i, j): want[i, j] for i in range(70) for j in range(70)}


def test_rows_that_repeat_add_up_and_nulls_are_left_out(spark):
    spec = FieldSpec()
    df = spark.createDataFrame([(1, [1, 2]), (1, [10, None]), (None, [5, 5]), (2, None), (3, []), (4, [7])] + [(9, [1, 1])] * 3000, "k long, v array<long>").repartition(7)
    got = {(r.i, r.j): r.y for r in blocks.cells(blocks.of_rows(df, "k", "v", 2, spec)).where("y > 0").collect()}
    assert got == {(1, 0): 11, (1, 1): 2, (4, 0): 7, (9, 0): 3000, (9, 1): 3000}
    assert blocks.of_rows(df.limit(0), "k", "v", 2, spec).count() == 0
    empty = blocks.of_rows(df.limit(0), "k", "v", 2, spec, transposed=True)
    assert blocks.product(blocks.shared(empty, "x", spec), blocks.shared(empty, "y", spec), spec).count() == 0
    with pytest.raises(Exception, match="entries"):
        blocks.of_rows(df, "k", "v", 1, spec).count()


def test_no_stage_has_a_row_for_a_cell(spark, sf):
    plan = QUERIES["matrix_product_shared"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.split("Exchange", 1)[-1]
