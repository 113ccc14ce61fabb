"""Encoding, sharing, resharing and products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import field as fd
from ..functions.lagrange import basis
from ..operators import beaver, sharing
from ..sources.tables import table
from ..spec import P61, FieldSpec
from .registry import P, S, fix, h, lift, mod, msum, mul, query, rs

ONE = FieldSpec()
FIVE = FieldSpec(n=5)
PACKED = FieldSpec(n=5, k=2)


def orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fd.encode(F.col("o_totalprice"), ONE).alias("s"))


def events(spark, d):
    return table(spark, d, "events").select("event_id", fd.encode(F.col("value"), ONE).alias("s0"), F.col("user_id").alias("s1"))


ORDERS = f"o AS (SELECT o_orderkey, {mod(fix('o_totalprice'))} AS s FROM orders)"
EVENTS = f"e AS (SELECT event_id, {mod(fix('value'))} AS s0, user_id AS s1 FROM events)"


def shares_sql(n: int, label: str = "share") -> str:
    return f"{ORDERS}, sh AS (SELECT o_orderkey, s, party, (s + {mul(h(chr(39) + label + chr(39), 'o_orderkey', 1), 'party')}) % {P} AS y FROM o, range(1, {n + 1}) r(party))"


def lam_sql(points, target, party="party", p=P):
    return "CASE " + party + " " + " ".join(f"WHEN {x} THEN {c}" for x, c in zip(points, basis(points, target, p), strict=True)) + " ELSE 0 END"


@query(f"SELECT o_orderkey, CAST(trunc(o_totalprice * {S}) AS BIGINT) % {P} AS y_trunc, CAST(round_even(o_totalprice * {S}, 0) AS BIGINT) % {P} AS y_rint, CAST(round(o_totalprice * {S}) AS BIGINT) % {P} AS y_round FROM orders")
def encode_fixed_point(spark, d):
    v = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", *(fd.encode(v, ONE, how).alias(f"y_{how}") for how in ("trunc", "rint", "round")))


@query(f"WITH e AS (SELECT c_custkey, {mod(fix('c_acctbal'))} AS field_y FROM customer) SELECT c_custkey, field_y, {lift('field_y')} AS signed_y FROM e")
def decode_signed(spark, d):
    own = table(spark, d, "customer").select("c_custkey", fd.encode(F.col("c_acctbal"), ONE).alias("field_y"))
    return own.withColumn("signed_y", fd.lift(F.col("field_y"), P))


@query(f"WITH {shares_sql(3)} SELECT o_orderkey, CAST(party AS INT) AS party, y FROM sh")
def shamir_share(spark, d):
    return sharing.share(orders(spark, d), "s", ["o_orderkey"], ONE)


@query(f"WITH {ORDERS} SELECT o_orderkey, s AS secret, s AS reconstructed FROM o")
def shamir_roundtrip(spark, d):
    own = orders(spark, d).withColumn("secret", F.col("s"))
    back = sharing.reconstruct(sharing.share(own, "s", ["o_orderkey"], ONE), ["o_orderkey", "secret"], ONE, out="reconstructed")
    return back


@query(f"WITH {ORDERS} SELECT o_orderkey, s AS from_12, s AS from_13, s AS from_23 FROM o")
def reconstruct_subset_invariance(spark, d):
    own = sharing.share(orders(spark, d), "s", ["o_orderkey"], ONE)
    parts = [fd.modsum(sharing.weighted(F.col("y"), F.col("party"), s, 0, P), P).alias(f"from_{s[0]}{s[1]}") for s in ([1, 2], [1, 3], [2, 3])]
    return own.groupBy("o_orderkey").agg(*parts)


def packed_sql(at: str = "party", n: int = 5) -> str:
    mask = h("'packed'", "event_id", 1)
    arms = []
    for i in range(1, n + 1):
        a, b, c = basis([-1, -2, 1], i, P)
        arms.append(f"WHEN {i} THEN (CAST(s0 AS HUGEINT) * {a} + CAST(s1 AS HUGEINT) * {b} + CAST({mask} AS HUGEINT) * {c} % {P}) % {P}")
    return f"{EVENTS}, ps AS (SELECT event_id, CAST(party AS INT) AS party, CAST(CASE party {' '.join(arms)} END AS BIGINT) AS y, s0, s1 FROM e, range(1, {n + 1}) r(party))"


@query(f"WITH {packed_sql()} SELECT event_id, party, y FROM ps")
def packed_share(spark, d):
    return sharing.packed_share(events(spark, d), ["s0", "s1"], ["event_id"], PACKED)


@query(f"WITH {EVENTS} SELECT event_id, CAST(0 AS INT) AS lane, s0 AS secret FROM e UNION ALL SELECT event_id, CAST(1 AS INT), s1 FROM e")
def packed_reconstruct(spark, d):
    return sharing.packed_reconstruct(packed_share(spark, d), ["event_id"], PACKED)


def unpack_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT event_id, {j} AS lane, party AS sender, {mul('y', lam_sql([1, 2, 3], -(j + 1)))} AS part FROM ps WHERE party <= 3" for j in (0, 1))
    return f"""{packed_sql()}, pt AS ({parts}),
    st AS (SELECT event_id, lane, CAST(r.party AS INT) AS party, (part + {mul(h("'unpack'", 'event_id', 'sender', 'lane', 1), 'r.party')}) % {P} AS y FROM pt, range(1, 6) r(party)),
    la AS (SELECT event_id, CAST(lane AS INT) AS lane, party, {msum('y')} AS y FROM st GROUP BY ALL)"""


@query(f"WITH {unpack_sql()} SELECT event_id, lane, party, y FROM la")
def packed_unpack_lanes(spark, d):
    return sharing.unpack(packed_share(spark, d), ["event_id"], PACKED)


def pack_sql() -> str:
    rows = []
    for j in range(1, 6):
        a, b = basis([-1, -2], j, P)
        hide = mul(h("'pack'", "event_id", 1), (j + 1) * (j + 2))
        term = mul(mul("y", lam_sql([1, 2], 0)), f"CASE lane WHEN 0 THEN {a} ELSE {b} END")
        rows.append(f"SELECT event_id, CAST({j} AS INT) AS party, ({msum(term)} + {hide}) % {P} AS y FROM la WHERE party <= 2 GROUP BY event_id")
    return f"{unpack_sql()}, pk AS ({' UNION ALL '.join(rows)})"


@query(f"WITH {pack_sql()} SELECT event_id, party, y FROM pk")
def lanes_to_packed(spark, d):
    return sharing.pack(packed_unpack_lanes(spark, d), ["event_id"], PACKED)


@query(f"WITH {shares_sql(5)} SELECT o_orderkey, CAST(j AS INT) AS new_party, {msum(mul('y', 'CASE j ' + ' '.join(f'WHEN {j} THEN {lam_sql([1, 2], j)}' for j in (2, 4, 7)) + ' END'))} AS y FROM sh, (VALUES (2), (4), (7)) v(j) WHERE party <= 2 GROUP BY o_orderkey, j")
def lagrange_redistribute(spark, d):
    own = sharing.share(orders(spark, d), "s", ["o_orderkey"], FIVE)
    return sharing.redistribute(own, ["o_orderkey"], [1, 2], [2, 4, 7], P)


_DELTA = " + ".join(f"CAST({mul(h(chr(39) + 'refresh' + chr(39), 'o_orderkey', k, 1), 'party')} AS HUGEINT)" for k in (1, 2, 3))


@query(f"WITH {shares_sql(3)} SELECT o_orderkey, CAST(party AS INT) AS party, CAST((y + {_DELTA}) % {P} AS BIGINT) AS y_new, s AS reconstructed FROM sh")
def herzberg_refresh(spark, d):
    new = sharing.refresh(sharing.share(orders(spark, d), "s", ["o_orderkey"], ONE), ["o_orderkey"], ONE)
    lam = sharing.weighted(F.col("y"), F.col("party"), [1, 2], 0, P)
    wide = new.groupBy("o_orderkey").agg(F.collect_list(F.struct("party", "y")).alias("v"), fd.modsum(lam, P).alias("reconstructed"))
    return wide.select("o_orderkey", F.explode("v").alias("s"), "reconstructed").select("o_orderkey", "s.party", F.col("s.y").alias("y_new"), "reconstructed")


@query(f"WITH {shares_sql(4, 'again')} SELECT o_orderkey, CAST(party AS INT) AS party, y FROM sh")
def reshare_via_reconstruct(spark, d):
    back = sharing.reconstruct(sharing.share(orders(spark, d), "s", ["o_orderkey"], FIVE), ["o_orderkey"], FIVE)
    return sharing.share(back, "secret", ["o_orderkey"], FieldSpec(n=4), "again")


@query(f"SELECT l_suppkey AS idx, {msum(mod(fix('l_extendedprice')))} AS y FROM lineitem GROUP BY l_suppkey")
def gradient_all_reduce(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("idx"), fd.encode(F.col("l_extendedprice"), ONE).alias("y"))
    return rows.groupBy("idx").agg(fd.modsum(F.col("y"), P).alias("y"))


@query(f"WITH {ORDERS} SELECT o.o_orderkey, (o.s + {mod(fix('c.c_acctbal'))}) % {P} AS y FROM o JOIN orders r ON o.o_orderkey = r.o_orderkey JOIN customer c ON r.o_custkey = c.c_custkey")
def homomorphic_add(spark, d):
    own = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = sharing.share(own.select("o_orderkey", fd.encode(F.col("o_totalprice"), ONE).alias("s"), fd.encode(F.col("c_acctbal"), ONE).alias("v")), "s", ["o_orderkey"], ONE)
    both = a.withColumn("y", fd.addmod(F.col("y"), sharing.own_share(F.col("v"), ["o_orderkey"], ONE, "other"), P))
    return sharing.reconstruct(both, ["o_orderkey"], ONE, out="y")


@query(f"WITH {ORDERS} SELECT o_orderkey, {mul('s', 12345)} AS y FROM o")
def scalar_multiply(spark, d):
    own = sharing.share(orders(spark, d), "s", ["o_orderkey"], ONE).withColumn("y", fd.mulmod(F.col("y"), 12345, P))
    return sharing.reconstruct(own, ["o_orderkey"], ONE, out="y")


def _triple_sql(idx: str) -> str:
    a, b = h("'a'", idx), h("'b'", idx)
    one = lambda v, n: f"({v} + {mul(h(chr(39) + 'triple_' + n + chr(39), idx, 1), 'party')}) % {P}"
    return f"{one(a, 'a')} AS a, {one(b, 'b')} AS b, {one(mul(a, b), 'c')} AS c"


@query(f"SELECT r.idx, CAST(party AS INT) AS party, {_triple_sql('r.idx')} FROM (SELECT o_orderkey AS idx FROM orders) r, range(1, 4) q(party)")
def beaver_triples(spark, d):
    """A triple for each order."""
    return beaver.triples(table(spark, d, "orders").select(F.col("o_orderkey").alias("idx")), ["idx"], ONE)


@query(f"SELECT o_orderkey, {mul(mod(fix('o_totalprice')), mod(fix('c_acctbal')))} AS product FROM orders JOIN customer ON o_custkey = c_custkey")
def beaver_multiply(spark, d):
    own = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = own.select("o_orderkey", fd.encode(F.col("o_totalprice"), ONE).alias("s"), fd.encode(F.col("c_acctbal"), ONE).alias("v"))
    return sharing.reconstruct(beaver.multiply_rows(own, "s", "v", ["o_orderkey"], ONE), ["o_orderkey"], ONE, out="product")


@query(f"WITH {EVENTS} SELECT event_id, CAST(0 AS INT) AS lane, {mul('s0', 's0')} AS product FROM e UNION ALL SELECT event_id, CAST(1 AS INT), {mul('s1', 's1')} FROM e")
def packed_multiply(spark, d):
    lanes = packed_unpack_lanes(spark, d)
    product = beaver.multiply(lanes, lanes, ["event_id", "lane"], PACKED)
    packed = sharing.pack(product, ["event_id"], PACKED)
    return sharing.packed_reconstruct(packed, ["event_id"], PACKED).withColumnRenamed("secret", "product")


@query(f"SELECT l_suppkey AS key, CAST(sum({rs(fix('l_extendedprice') + ' * ' + fix('l_discount'), S)}) AS BIGINT) AS y FROM lineitem GROUP BY l_suppkey")
def fixed_point_multiply(spark, d):
    own = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), fd.rescale(fd.fixed(F.col("l_extendedprice"), S) * fd.fixed(F.col("l_discount"), S), S).alias("y"))
    return own.groupBy("key").agg(F.sum("y").alias("y"))


@query(f"""WITH v AS (SELECT o_orderkey, {fix('o_totalprice', 100)} - 15000000 AS v FROM orders)
SELECT o_orderkey, {rs('v', 1000)} AS nearest, CAST((v + CASE WHEN v < 0 THEN -500 ELSE 500 END - (((v + CASE WHEN v < 0 THEN -500 ELSE 500 END) % 1000) + 1000) % 1000) // 1000 AS BIGINT) AS floored FROM v""")
def rescale_variants(spark, d):
    v = fd.fixed(F.col("o_totalprice"), 100) - 15000000
    return table(spark, d, "orders").select("o_orderkey", fd.rescale(v, 1000).alias("nearest"), fd.rescale_floor(v, 1000).alias("floored"))


@query("""WITH m AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(DISTINCT user_id) AS n FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, CAST(t AS INT) AS t, CAST(s AS INT) AS s, n, 2 * (t + s - 1) < n AS safe, CAST(greatest(1, least(16, (n - 2 * t + 1) // 2)) AS INT) AS max_k FROM m, range(0, 4) a(t), range(1, 6) b(s)""")
def safety_bound(spark, d):
    """For each day's active users as parties: whether thresholds and packings are safe, and the most."""
    days = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count_distinct("user_id").alias("n"))
    grid = days.withColumn("t", F.explode(F.lit([0, 1, 2, 3]))).withColumn("s", F.explode(F.lit([1, 2, 3, 4, 5])))
    return grid.withColumns({"safe": 2 * (F.col("t") + F.col("s") - 1) < F.col("n"), "max_k": F.greatest(F.lit(1), F.least(F.lit(16), F.expr("cast((n - 2 * t + 1) div 2 as int)")))})


_SMALL = 11  # numbers of orders are taken mod this, so that their inverses are a short list


@query(f"""WITH t AS (SELECT o_custkey AS key, {msum(mod(fix('o_totalprice', 100)))} AS total, count(*) % {_SMALL} AS n FROM orders GROUP BY o_custkey)
SELECT key, total, CAST(n AS BIGINT) AS n, CASE n {' '.join(f'WHEN {k} THEN {mul("total", pow(k, -1, P))}' for k in range(1, _SMALL))} ELSE 0 END AS y FROM t""")
def field_average(spark, d):
    """The sum times the field inverse of a count; no inverse of 0, which gives 0."""
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), fd.field(fd.fixed(F.col("o_totalprice"), 100), P).alias("v"))
    own = own.groupBy("key").agg(fd.modsum(F.col("v"), P).alias("total"), (F.count("*") % _SMALL).alias("n"))
    by = F.coalesce(*(F.when(F.col("n") == k, fd.mulmod(F.col("total"), pow(k, -1, P), P)) for k in range(1, _SMALL)), F.lit(0).cast("long"))
    return own.select("key", "total", "n", by.alias("y"))


@query(f"SELECT o_orderkey, {mod(fix('o_totalprice', 100))} AS num, {mul(mod(fix('o_totalprice', 100)), pow(5, -1, P))} AS fifth, {mul(mod(fix('o_totalprice', 100)), pow(4, -1, P))} AS quarter FROM orders")
def field_division(spark, d):
    """Values divided by public numbers in the field: times their inverses."""
    from ..functions.lagrange import inverse

    own = table(spark, d, "orders").select("o_orderkey", fd.field(fd.fixed(F.col("o_totalprice"), 100), P).alias("num"))
    return own.withColumns({"fifth": fd.mulmod(F.col("num"), inverse(5, P), P), "quarter": fd.mulmod(F.col("num"), inverse(4, P), P)})
