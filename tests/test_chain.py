"""Newton steps, chains of committees, collective sums, memoised tables: against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sharemill.functions.lagrange import basis
from sharemill.functions.tables import register
from sharemill.operators import chain, collective, membership, memo, metrics, nonlinear, sharing
from sharemill.spec import P61, FieldSpec


def test_reciprocal_root_is_within_its_bound(spark):
    r = random.Random(1)
    values = [1, 2, 3, 4, 5, (1 << 62) - 1] + [r.randrange(1, 1 << r.randrange(1, 62)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [0, *values]], "n long")
    for row in nonlinear.with_rsqrt(df, "n", "r").collect():
        if row.n == 0:
            assert row.r.y == 0
        else:
            got = row.r.y / 2.0**30 / 2.0 ** (15 + row.r.s)
            assert abs(got * math.sqrt(row.n) - 1) < 2.0**-26


def test_clipped_entries_are_within_one_unit(spark):
    r = random.Random(2)
    rows = [(k, [r.randrange(-(1 << (4 + k % 20)), 1 << (4 + k % 20)) for _ in range(1 + k % 9)]) for k in range(600)] + [(900, [0, 0]), (901, []), (902, [1 << 24, -(1 << 24)])]
    limit = 70_000
    df = spark.createDataFrame(rows, "id long, x array<long>")
    for row in nonlinear.clip_norm(df, "x", limit).collect():
        n = sum(v * v for v in row.x)
        assert row.norm_sq == n
        if n <= limit * limit:
            assert row.clipped == row.x
        else:
            assert all(abs(c - v * limit / math.sqrt(n)) <= 1 for c, v in zip(row.clipped, row.x, strict=True))


def test_quotients_are_the_nearest(spark):
    r = random.Random(3)
    rows = [(r.randrange(-(1 << 44), 1 << 44), r.choice([1, -1]) * r.randrange(1, 1 << r.randrange(1, 30))) for _ in range(3000)] + [(7, 0), (0, 5), (1, 2), (-1, 2), ((1 << 44) - 1, 1), ((1 << 44) - 1, (1 << 30) - 1)]
    scale = 1 << 16
    df = spark.createDataFrame(rows, "a long, b long")
    for row in nonlinear.with_quotient(df, "a", "b", scale, "q").collect():
        if row.b == 0:
            assert row.q is None
        else:
            n, d = abs(row.a) * scale, abs(row.b)
            assert row.q == (-1 if (row.a < 0) != (row.b < 0) else 1) * ((2 * n + d) // (2 * d))


def walk(events, secrets, spec):
    """Shares after each event, by passing them on one change after the other."""
    active = set(range(1, spec.n + 1))
    own = {k: dict(v) for k, v in secrets.items()}
    out = {}
    for i, _, party, kind in sorted(events, key=lambda e: (e[1], e[0])):
        new = active | {party} if kind == "join" else active - {party} if kind == "drop" else active
        stay = sorted(active & new)
        if new != active:
            use = stay[: spec.t + 1]
            own = {k: {j: sum(c * y[s] for s, c in zip(use, basis(use, j, spec.p), strict=True)) % spec.p for j in new} for k, y in own.items()}
        active = new
        out[i] = (sorted(active), {k: {j: y.get(j, 0) for j in active} for k, y in own.items()})
    return out


@pytest.mark.parametrize("span_rows", [1 << 20, 10])
def test_shares_go_through_the_chain(spark, monkeypatch, span_rows):
    monkeypatch.setattr(membership, "SPAN_ROWS", span_rows)
    r, spec = random.Random(5), FieldSpec(n=5, t=1)
    log, active = [], set(range(1, 6))
    for k in range(90):
        p, kind = r.randrange(1, 6), r.choice(["join", "drop", "drop", "view"])
        if kind == "drop" and len(active - {p}) < 2:
            kind = "view"
        active = active | {p} if kind == "join" else active - {p} if kind == "drop" else active
        log.append((k, 1000 + 7 * k + r.randrange(3), p, kind))
    events = spark.createDataFrame(log, "event_id long, s long, party int, kind string").select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "party", "kind").repartition(4)
    found = chain.scanned(chain.products(events, "ts", "event_id", "party", "kind", spec), spec)
    rows = [(k, k % 90, [r.randrange(P61)] * 5) for k in range(180)]
    rows = [(k, e, [(s[0] + 17 * j * (k + 1)) % P61 for j in range(1, 6)]) for k, e, s in rows]
    first = spark.createDataFrame(rows, "k long, event_id long, shares array<long>")
    got = {}
    for x in chain.moved(first, ["k"], found, "event_id", spec).collect():
        got.setdefault(x.k, {})[x.party] = x.y
    want = walk(log, {k: dict(enumerate(s, 1)) for k, _, s in rows}, spec)
    assert got == {k: want[e][1][k] for k, e, _ in rows if want[e][0]}
    assert {x.event_id: list(x.committee) for x in found.collect()} == {i: c for i, (c, _) in want.items()}
    with pytest.raises(Exception, match="too few"):
        lost = events.withColumn("kind", F.lit("drop"))
        chain.products(lost, "ts", "event_id", "party", "kind", spec).count()


def test_collective_sums(spark):
    r = random.Random(7)
    rows = [(1 + k % 4, r.choice([3, 3, 3, r.randrange(40)]), r.randrange(P61)) for k in range(3000)] + [(1, None, 5), (1, 5, None)]
    df = spark.createDataFrame(rows, "party int, idx long, y long").repartition(6)
    owned = collective.reduce_scatter(df, 4, P61)
    want = {}
    for _, i, y in rows:
        if i is not None and y is not None:
            s, n = want.get(i, (0, 0))
            want[i] = ((s + y) % P61, n + 1)
    assert {x.idx: (x.y, x.terms) for x in owned.collect()} == want and all(x.owner == x.idx % 4 + 1 for x in owned.collect())
    every = collective.all_gather(owned, 4).collect()
    assert len(every) == 4 * len(want) and {x.dest for x in every} == {1, 2, 3, 4}
    assert collective.reduce_scatter(df.limit(0), 4, P61).count() == 0


def test_memo_works_on_misses_only(spark, tmp_path, monkeypatch):
    asked = []

    def compute(keys):
        asked.append(sorted(x.k for x in keys.collect()))
        return keys.withColumn("v", F.col("k") * F.col("k"))

    m = memo.Memo(f"file://{tmp_path}/memo", "k", compute)
    ask = lambda ks: {(x.k, x.v, x.hit) for x in m.lookup(spark.createDataFrame([(k,) for k in ks], "k long")).collect()}
    assert ask([1, 2, 2, None]) == {(1, 1, False), (2, 4, False), (None, None, False)} and m.metrics["misses"] == 2
    assert ask([2, 3]) == {(2, 4, True), (3, 9, False)} and m.metrics == {"hits": 1, "misses": 1, "parts": 2}
    assert ask([1, 2, 3]) == {(1, 1, True), (2, 4, True), (3, 9, True)} and m.metrics == {"hits": 3, "misses": 0, "parts": 2}
    assert asked == [[1, 2], [3], []]
    assert ask([]) == set()
    (tmp_path / "memo/part=000002").mkdir(exist_ok=True)  # broke off while it was written
    assert ask([4]) == {(4, 16, False)} and ask([4]) == {(4, 16, True)}
    monkeypatch.setattr(memo, "COMPACT", 2)
    m.compact(spark)
    assert len(m.parts(spark)) == 1 and ask([1, 2, 3, 4, 5]) == {(1, 1, True), (2, 4, True), (3, 9, True), (4, 16, True), (5, 25, False)}
    assert asked[-1] == [5]


def test_k_least_of_groups(spark, monkeypatch):
    monkeypatch.setattr(metrics, "MOST_HELD", 8)
    r = random.Random(9)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([None, *range(500)]), k) for k in range(4000)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(9)
    got = {}
    for x in metrics.k_least(df, "g", "o", 5).collect():
        got.setdefault(x.g, []).append(x.o)
    want = {}
    for g, o, _ in rows:
        want.setdefault(g, []).append(o)
    assert {g: sorted(o) for g, o in got.items()} == {g: sorted(sorted(x for x in o if x is not None)[:5]) for g, o in want.items()}
    assert metrics.k_least(df.limit(0), "g", "o", 5).count() == 0


def test_table_function_equals_the_operator(spark):
    register(spark)
    spec = FieldSpec(n=5, t=2)
    df = spark.createDataFrame([(k, k * 1234567 % P61) for k in range(50)] + [(99, None)], "id long, s long")
    got = spark.sql("SELECT id, party, y FROM {df}, LATERAL shamir_share(s, 5, 2, CAST(id AS STRING))", df=df).collect()
    want = sharing.share(df.where("s is not null"), "s", ["id"], spec).select("id", "party", "y").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.sql("SELECT * FROM shamir_share(7, 3, 0, 'x')").count() == 3


@pytest.mark.parametrize("span_rows,asked_rows", [(1 << 14, 1 << 16), (8, 5)])
def test_chain_keeps_shares_that_a_small_committee_would_lose(spark, monkeypatch, span_rows, asked_rows):
    monkeypatch.setattr(chain, "SPAN_ROWS", span_rows)
    monkeypatch.setattr(chain, "ASKED_ROWS", asked_rows)
    monkeypatch.setattr(chain, "ROWS_AT_ONCE", 7)
    spec, kinds = FieldSpec(n=4, t=1), ["drop"] * 4 + ["join"] * 4
    log = [(k, 10 * k, None if k % 9 == 8 else k % 4 + 1, kinds[k % 8]) for k in range(60)]  # all leave, all come back; some parties are unknown
    events = spark.createDataFrame(log, "event_id long, s long, party int, kind string").select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "party", "kind").repartition(3)
    found = chain.scanned(chain.products(events, "ts", "event_id", "party", "kind", spec, fallback=True), spec)
    share = lambda k, j: (k + (k * k + 3) * j) % P61
    first = spark.createDataFrame([(k, k % 60, [share(k, j) for j in range(1, 5)]) for k in range(200)], "k long, event_id long, shares array<long>")
    got = {(r.k, r.party): r.y for r in chain.moved(first, ["k"], found, "event_id", spec).collect()}
    active, after = {1, 2, 3, 4}, []
    for _, _, p, kind in log:
        active = active if p is None else active | {p} if kind == "join" else active - {p}
        after.append(active)
    assert got == {(k, j): share(k, j) for k in range(200) for j in after[k % 60]}


def test_chain_has_a_matrix_for_a_span_only(spark, monkeypatch):
    monkeypatch.setattr(chain, "SPAN_ROWS", 100)
    spec = FieldSpec(n=24)
    events = spark.range(1000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) as ts", "cast(id * 7 % 24 + 1 as int) as party", "if(id % 2 = 0, 'join', 'drop') as kind")
    found = chain.products(events, "ts", "event_id", "party", "kind", spec, fallback=True).collect()
    sizes = {}
    for r in found:
        sizes.setdefault(r.span, []).append(r.m is not None)
    assert len(found) == 1000 and len(sizes) >= 9 and all(sum(s) == 1 for s in sizes.values())
    assert max(map(len, sizes.values())) <= 200
