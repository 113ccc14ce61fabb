"""Field arithmetic, sharing and products against Python's integers."""

import random

import pytest
from pyspark.sql import functions as F

from sharemill.functions import field as fd
from sharemill.functions.lagrange import basis, inverse, vanishing
from sharemill.operators import beaver, nonlinear, sharing
from sharemill.spec import P31, P32, P61, FieldSpec, most_packed, safe


def near(v, d):
    return (1 if v >= 0 else -1) * ((2 * abs(v) + d) // (2 * d))


@pytest.mark.parametrize("p", [P31, P32, P61, 1009])
def test_products_are_exact(spark, p):
    rng = random.Random(p)
    edge = [0, 1, 2, p - 1, p - 2, p // 2, p // 2 + 1]
    rows = [(a, b) for a in edge for b in edge] + [(rng.randrange(p), rng.randrange(p)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a long, b long")
    c = p - 3
    got = df.select(fd.mulmod(F.col("a"), F.col("b"), p), fd.mulmod(F.col("a"), c, p), fd.addmod(F.col("a"), F.col("b"), p), fd.submod(F.col("a"), F.col("b"), p)).collect()
    assert [tuple(r) for r in got] == [(a * b % p, a * c % p, (a + b) % p, (a - b) % p) for a, b in rows]


def test_lift_and_rescale(spark):
    rows = [(v, d) for v in (-1501, -1500, -500, -499, -1, 0, 1, 499, 500, 1500, 10**17) for d in (1, 7, 1000)]
    df = spark.createDataFrame(rows, "v long, d long")
    got = [tuple(r) for r in df.select(fd.rescale(F.col("v"), F.col("d")), fd.lift(fd.field(F.col("v"), P61), P61)).collect()]
    assert got == [(near(v, d), v) for v, d in rows]


def test_interpolation():
    assert sum(c * y for c, y in zip(basis([1, 2, 3], 7, 127), (11, 22, 33), strict=True)) % 127 == 77
    assert vanishing([-1, -2], -2, P61) == 0 and 20 * inverse(4, P61) % P61 == 5
    with pytest.raises(ZeroDivisionError):
        inverse(P61, P61)
    with pytest.raises(ValueError):
        basis([1, 1], 0, P61)


@pytest.mark.parametrize("spec", [FieldSpec(p=P31, n=5), FieldSpec(n=5, t=2), FieldSpec(p=1009, n=5, t=2)])
def test_shares_come_back_and_move(spark, spec):
    df = spark.createDataFrame([(k, v) for k, v in enumerate((0, 42, 1, spec.p - 1, 500))], "k long, s long")
    want = {0: 0, 1: 42, 2: 1, 3: spec.p - 1, 4: 500}
    shares = sharing.share(df, "s", ["k"], spec)
    assert shares.count() == 25
    back = lambda s, **kw: {r.k: r.secret for r in sharing.reconstruct(s, ["k"], spec, **kw).collect()}
    assert back(shares) == want and back(shares, parties=[2, 4, 5][: spec.t + 1]) == want
    assert back(sharing.refresh(shares, ["k"], spec)) == want
    moved = sharing.redistribute(shares, ["k"], [1, 2, 3], [10, 11, 12], spec.p).withColumnRenamed("new_party", "party")
    assert back(moved, parties=[10, 11, 12]) == want
    with pytest.raises(ValueError):
        sharing.reconstruct(shares, ["k"], spec, parties=[1])


def test_packed_lanes(spark):
    spec = FieldSpec(n=5, k=2)
    df = spark.createDataFrame([(k, k * k, P61 - k - 1) for k in range(20)], "k long, a long, b long")
    packed = sharing.packed_share(df, ["a", "b"], ["k"], spec)
    want = {(k, lane): v for k in range(20) for lane, v in enumerate((k * k, P61 - k - 1))}
    get = lambda s: {(r.k, r.lane): r.secret for r in sharing.packed_reconstruct(s, ["k"], spec).collect()}
    assert get(packed) == want
    lanes = sharing.unpack(packed, ["k"], spec)
    assert get(sharing.pack(lanes, ["k"], spec)) == want
    product = sharing.pack(beaver.multiply(lanes, lanes, ["k", "lane"], spec), ["k"], spec)
    assert get(product) == {k: v * v % P61 for k, v in want.items()}


def test_beaver_products(spark):
    pairs = [(10, 20), (10, 0), (P61 - 10, 5), (10, 2), (20, 3), (30, 4)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, a long, b long")
    spec = FieldSpec()
    x, y = sharing.share(df.select("k", "a"), "a", ["k"], spec, "x"), sharing.share(df.select("k", "b"), "b", ["k"], spec, "y")
    got = {r.k: r.secret for r in sharing.reconstruct(beaver.multiply(x, y, ["k"], spec), ["k"], spec).collect()}
    assert [got[k] for k in range(6)] == [a * b % P61 for a, b in pairs]


def test_comparisons_and_division(spark):
    df = spark.createDataFrame([(20, 10), (10, 20), (10, 10), (P61 - 1, 1)], "a long, b long")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in df.select(nonlinear.greater(a, b, P61), nonlinear.less(a, b, P61), nonlinear.equal(a, b, P61)).collect()]
    assert got == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 0)]
    one = spark.createDataFrame([(7, 0), (7, 2), (-7, 2), (7, -2)], "a long, b long")
    assert [r[0] for r in one.select(nonlinear.divide(a, b, 10, "null")).collect()] == [None, 35, -35, -35]
    assert one.select(nonlinear.divide(a, b, 10, "zero")).first()[0] == 0
    with pytest.raises(Exception, match="ZERO"):
        one.select(nonlinear.divide(a, b, 10)).collect()


def test_softmax_sums_to_scale(spark):
    scale = 10**7
    df = spark.createDataFrame([([2 * scale, scale, scale // 2],), ([0, 0, 0],), ([-9 * scale, 9 * scale, 0],)], "z array<long>")
    got = [r.p for r in nonlinear.softmax(df, "z", 3, "p", scale).collect()]
    assert all(sum(p) == scale and min(p) >= 0 for p in got)
    assert got[0][0] > got[0][1] > got[0][2] and got[2][1] == max(got[2])


def test_safety():
    assert [safe(*x) for x in ((1, 1, 3), (1, 1, 2), (1, 2, 4), (1, 2, 5))] == [True, False, False, True]
    assert most_packed(1, 5) == 2 and most_packed(9, 3) == 1
    with pytest.raises(ValueError):
        FieldSpec(n=2, t=2)
