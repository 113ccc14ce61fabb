import numpy as np
import pytest

from sharemill.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, x string, component string"


def brute(rows):
    """By the covariance's eigenvectors: {row: values}, n, explained, deviations."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in fine)
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in fine], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    e, vec = np.linalg.eigh(y.T @ y / n)
    return fine, x, n, s, e[::-1], vec[:, ::-1]


def check(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x", "c") for i, v in rows], SCHEMA).repartition(7)
    got = whitening.whitened(df).collect()
    fine, x, n, s, e, vec = brute(rows)
    k = min(whitening.MOST, len(e))
    assert len(got) == k * len(fine) and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    sign = np.zeros(k)
    for (i, _), own in zip(fine, x, strict=True):
        assert by[i][1].deviation == sum(int(n * a - b) ** 2 for a, b in zip(own.tolist(), s.tolist(), strict=True))
        want = ((n * own - s) / n) @ vec[:, :k]
        for c in range(k):
            r = by[i][c + 1]
            if e[c] > 1e-9 * e[0]:
                w = want[c] / np.sqrt(e[c])
                if abs(w) > 1e-3:
                    sign[c] = sign[c] or np.sign(w * r.whitened)
                assert r.whitened == pytest.approx(sign[c] * w if sign[c] else w, abs=2e-3 if not sign[c] else 1e-7)
                assert r.explained == pytest.approx(e[c] / e.sum(), rel=1e-6)
            else:
                assert r.whitened == 0 and r.explained == pytest.approx(0, abs=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6


def test_equal_to_eigenvectors_of_the_covariance(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(700, 24)) @ np.diag(np.linspace(0.5, 3, 24))
    rows = [(k, x[k].tolist()) for k in range(700)]
    rows += [(1000 + k, x[3].tolist()) for k in range(350)]  # copies don't weigh
    rows += [(5000, None), (5001, [float("nan")] * 24), (5002, [None] * 24), (5003, [float("inf")] * 24), (5004, []), (5005, x[0][:20].tolist())]
    check(spark, rows)


def test_fewer_vectors_than_dimensions(spark):
    r = np.random.default_rng(4)
    check(spark, [(k, r.normal(size=20).tolist()) for k in range(6)])


def test_narrow_vectors_and_one_vector(spark):
    r = np.random.default_rng(6)
    check(spark, [(k, r.normal(size=3).tolist()) for k in range(50)])
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whitened(df).collect()
    assert len(got) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, 0.0, 0.0, 0.0)}


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.whitened(df).count() == 0 and whitening.whitened(df.limit(0)).columns[0] == "vec_id"


def test_factors_merge_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGE", 2)
    r = np.random.default_rng(8)
    x = r.integers(-50, 50, (400, 10)) + 1_000_000
    fit = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(13)
    n, s = whitening.sums(fit)
    assert n == 400 and s == x.sum(axis=0).tolist()
    y = x - x.mean(axis=0)
    f = whitening.factor(fit, n, s)
    assert np.allclose(f.T @ f, y.T @ y)


def test_exact_deviations():
    x = np.array([[1 << 40, -(1 << 40)], [3, 5]], np.int64)
    n, s = 3, [1 << 40, 7]
    assert whitening.deviations(x[1:], 3, [9, 14]) == [(9 - 9) ** 2 + (15 - 14) ** 2]
    assert whitening.deviations(x, n, s)[0] is None
