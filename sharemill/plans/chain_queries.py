"""Newton steps, chains of committees, collective sums, memoised tables and SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import field as fd
from ..functions.tables import register
from ..operators import chain, collective, frames, memo, nonlinear, sharing
from ..sources.tables import table, vectors
from ..spec import FieldSpec
from ..streaming.streams import shared_dir
from .field_queries import orders, shares_sql
from .registry import P, S, X, fix, h, mod, msum, mul, query, rs

ONE = FieldSpec()
LIMIT = 4 * S
_ONE = 1 << nonlinear.BITS


def _rsqrt_sql(n: str) -> str:
    """CTEs from t0(vec_id, n): tk has the root y and the shift s."""
    b = nonlinear.BITS
    ctes = [f"t1 AS (SELECT vec_id, greatest({n}, 1) AS n, CAST(floor((length(bin(greatest({n}, 1))) - 29) / 2) AS INT) AS s FROM t0)", "t2 AS (SELECT *, CASE WHEN s >= 0 THEN n >> (2 * s) ELSE n << (-2 * s) END AS m FROM t1)", f"y0 AS (SELECT *, {11 * _ONE // 5} - (m * 6) // 5 AS y FROM t2)"]
    ctes += [f"y{k + 1} AS (SELECT vec_id, n, s, m, (y * ({3 * _ONE} - ((((y * y) >> {b}) * m) >> {b}))) >> {b + 1} AS y FROM y{k})" for k in range(nonlinear.STEPS)]
    return ", ".join(ctes)


@query(f"""WITH {X}, v AS (SELECT vec_id, j, y * (label + 1) AS y FROM x), t0 AS (SELECT vec_id, CAST(sum(y * y) AS BIGINT) AS norm FROM v GROUP BY vec_id), {_rsqrt_sql('norm')},
f AS (SELECT vec_id, n, CASE WHEN n > 0 THEN CASE WHEN s >= -15 THEN (y * {LIMIT}) >> (15 + s) ELSE (y * {LIMIT}) << (-15 - s) END ELSE 0 END AS f FROM y{nonlinear.STEPS})
SELECT v.vec_id, CAST(j AS INT) AS j, n AS norm_sq, CASE WHEN n <= {LIMIT * LIMIT} THEN v.y ELSE {rs('v.y * f', f'CAST({_ONE} AS BIGINT)')} END AS y FROM v JOIN f USING (vec_id)""")
def norm_clip_scaled(spark, d):
    """Vectors, stretched by their label, scaled down to norm 4 where they are longer."""
    own = vectors(spark, d, S).select("vec_id", F.transform("x", lambda v: v * (F.col("label") + 1)).alias("x"))
    own = nonlinear.clip_norm(own, "x", LIMIT)
    return own.select("vec_id", "norm_sq", F.posexplode_outer("clipped").alias("j", "y"))


@query(f"WITH v AS (SELECT o_orderkey, {fix('o_totalprice', 100)} - 15000000 AS num, o_custkey % 1000 + 1 AS den FROM orders) SELECT o_orderkey, {rs(f'num * {S}', 'den')} AS y FROM v")
def divide_newton(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", (fd.fixed(F.col("o_totalprice"), 100) - 15000000).alias("num"), (F.col("o_custkey") % 1000 + 1).alias("den"))
    return nonlinear.with_quotient(own, "num", "den", S, "y").select("o_orderkey", "y")


#: A committee of 24, of whom events join and drop some.
MANY = FieldSpec(n=24)
_CHAIN = f"""ev AS (SELECT event_id, ts, user_id % {MANY.n} + 1 AS node, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 0 END AS st FROM events),
g AS (SELECT event_id, ts, q.party, CASE WHEN node = q.party THEN st END AS st FROM ev, range(1, {MANY.n + 1}) q(party)),
a AS (SELECT event_id, party, coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY party ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1) AS active FROM g)"""


@query(f"WITH {_CHAIN}, {shares_sql(MANY.n)}, n AS (SELECT count(*) AS n FROM events) SELECT sh.o_orderkey, a.event_id, CAST(sh.party AS INT) AS party, sh.y FROM sh, n, a WHERE a.event_id = sh.o_orderkey % n.n AND a.party = sh.party AND a.active = 1")
def committee_chain_shares(spark, d):
    """Every order's shares as its committee holds them after an event of the log: orders meet their event's
    span of the log, and the first shares go through all changes of the committee up to then."""
    kind = F.when(F.col("event_type") == "signup", chain.JOIN).when(F.col("event_type") == "error", chain.DROP)
    log = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % MANY.n + 1).alias("party"), kind.alias("kind"))
    found = chain.scanned(chain.products(log, "ts", "event_id", "party", "kind", MANY, fallback=True), MANY)
    own = chain.located(orders(spark, d).withColumn("event_id", F.col("o_orderkey") % log.count()), found, "event_id")
    own = own.withColumns({f"_m{k}": m for k, m in enumerate(sharing.masks(MANY, "share", F.col("o_orderkey")))})
    first = F.array(*(sharing.at_party(F.col("s"), i, [F.col(f"_m{k}") for k in range(MANY.t)], P) for i in MANY.parties))
    return chain.moved(own.select("o_orderkey", "event_id", "at_span", "at_place", first.alias("shares")), ["o_orderkey"], found, "event_id", MANY)


@query(f"WITH {_CHAIN}, {shares_sql(MANY.n)}, n AS (SELECT count(*) AS n FROM events) SELECT DISTINCT sh.o_orderkey, sh.s AS secret FROM sh, n, a WHERE a.event_id = sh.o_orderkey % n.n AND a.party = sh.party AND a.active = 1")
def committee_chain_opened(spark, d):
    """What the lowest and the highest of those committees' members open: the first secrets. Numbers alone are
    aggregated, by hashes and before the shuffle."""
    own = committee_chain_shares(spark, d)
    two = own.groupBy("o_orderkey").agg(F.min("party").alias("i"), F.min_by("y", "party").alias("a"), F.max("party").alias("j"), F.max_by("y", "party").alias("b"))
    # the coefficients of each pair of members are literals
    lam = F.lit([[0 if i == j else j * pow(j - i, -1, P) % P for j in range(MANY.n + 1)] for i in range(MANY.n + 1)]).cast("array<array<bigint>>")
    term = lambda y, at, other: fd.mulmod(F.col(y), F.get(F.get(lam, F.col(at)), F.col(other)), P)
    return two.where("i < j").select("o_orderkey", fd.addmod(term("a", "i", "j"), term("b", "j", "i"), P).alias("secret"))


PARTIES = 7
_SCATTER = f"r AS (SELECT CAST(l_suppkey % {PARTIES} + 1 AS INT) AS owner, l_suppkey AS idx, {msum(mod(fix('l_extendedprice')))} AS y, count(*) AS terms FROM lineitem GROUP BY l_suppkey)"


def parts(spark, d):
    """A gradient of each party, a party being a line's number."""
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("party"), F.col("l_suppkey").alias("idx"), fd.encode(F.col("l_extendedprice"), ONE).alias("y"))


@query(f"WITH {_SCATTER} SELECT owner, idx, y, terms FROM r")
def gradient_reduce_scatter(spark, d):
    return collective.reduce_scatter(parts(spark, d), PARTIES, P)


@query(f"WITH {_SCATTER} SELECT CAST(dest AS INT) AS dest, owner, idx, y, terms, {rs('y', 'terms')} AS mean FROM r, range(1, {PARTIES + 1}) q(dest)")
def gradient_all_gather(spark, d):
    """Every party's copy of every sum, with the mean of its terms."""
    own = collective.all_gather(collective.reduce_scatter(parts(spark, d), PARTIES, P), PARTIES)
    return own.withColumn("mean", fd.rescale(F.col("y"), F.col("terms")))


@query(f"""WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') SELECT o.o_orderkey, o.o_custkey, {mod(fix('c_acctbal'))} AS y, k.o_custkey IS NOT NULL AS hit FROM orders o JOIN customer ON o.o_custkey = c_custkey LEFT JOIN k ON k.o_custkey = o.o_custkey""")
def memo_lookup(spark, d):
    """All orders ask for their customer's balance; customers that orders before 1998 asked for are in the
    table already, so only the others' balances are opened."""
    every = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")

    def opened(keys):
        own = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), fd.encode(F.col("c_acctbal"), ONE).alias("s")).join(keys, "o_custkey", "left_semi")
        return sharing.reconstruct(sharing.share(own, "s", ["o_custkey"], ONE, "memo"), ["o_custkey"], ONE, out="y")

    kept = memo.Memo(f"{shared_dir(spark).rstrip('/')}/memo-{uuid.uuid4().hex}", "o_custkey", opened)
    kept.lookup(every.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    return kept.lookup(every.drop("o_orderdate"))


@query(f"WITH {shares_sql(3)} SELECT o_orderkey, CAST(party AS INT) AS party, y FROM sh")
def sql_shamir_share(spark, d):
    """shamir_share as a table function in a SQL query."""
    register(spark)
    return spark.sql("SELECT o.o_orderkey, s.party, s.y FROM {own} o, LATERAL shamir_share(o.s, 3, 1, CAST(o.o_orderkey AS STRING)) s", own=orders(spark, d))


@query("SELECT conv_id, turn, role, sha256(coalesce(text, '')) AS text_hash, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes FROM conversations")
def frames_round_trip(spark, d):
    """Every conversation is a stream of frames, a turn's text its payload, cut into chunks of 1,000 bytes
    and split into frames again."""
    own = table(spark, d, "conversations")
    header = F.to_json(F.struct("turn", "role"))
    sent = own.select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), frames.frame(header, F.coalesce("text", F.lit("")).cast("binary")).alias("frame"))
    got = frames.split(frames.chunked(sent, 1000)).where("error is null")
    head = F.from_json("header", "turn long, role string")
    return got.select(F.col("stream").alias("conv_id"), head["turn"].alias("turn"), head["role"].alias("role"), F.sha2("payload", 256).alias("text_hash"), F.length("payload").cast("long").alias("bytes"))


@query(f"WITH {X}, m AS (SELECT vec_id, max({mod('y')}) > 4294967295 AS wide FROM x GROUP BY vec_id) SELECT x.vec_id, CAST(j AS INT) AS j, {mod('y')} AS y, CASE WHEN wide THEN 8 ELSE 4 END AS width FROM x JOIN m USING (vec_id)")
def vector_codec(spark, d):
    """Vectors of field elements as bytes of 4 or 8 a value, and back."""
    own = vectors(spark, d, S).select("vec_id", F.transform("x", lambda v: fd.field(v, P)).alias("v")).withColumn("width", frames.width(F.col("v")))
    sent = own.select("vec_id", "width", frames.vector_bytes(F.col("v"), F.col("width")).alias("payload"))
    return sent.select("vec_id", "width", F.posexplode_outer(frames.vector_of(F.col("payload"), F.col("width"))).alias("j", "y"))
