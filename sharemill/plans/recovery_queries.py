"""Resharing under a changed committee, recovery decisions, and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import field as fd
from ..operators import membership, messages, model, recovery, sharing
from ..sources.tables import table, vectors
from ..spec import FieldSpec
from .field_queries import FIVE, lam_sql, orders, shares_sql
from .registry import MEANS, P, S, X, h, msum, mul, query
from .run_queries import _TL, timeline

OLD, NEW = [1, 2, 3, 4, 5], [2, 3, 5, 6]
_USE = recovery.senders(OLD, NEW, 1)
_TARGET = "CASE j " + " ".join(f"WHEN {j} THEN {lam_sql(_USE, j)}" for j in NEW) + " END"
_THERE = "CAST(concat('0x', substr(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(party AS VARCHAR))), 1, 8)) AS BIGINT) % 10 < 8"
_KEPT = f"""{shares_sql(5)}, av AS (SELECT o_orderkey, party, y FROM sh WHERE {_THERE}), ok AS (SELECT o_orderkey, count_if(party IN {tuple(_USE)}) = 2 AS whole FROM av GROUP BY o_orderkey),
rk AS (SELECT a.o_orderkey, CAST(j AS INT) AS party, {msum(mul('a.y', _TARGET))} AS y, true AS reshared FROM (SELECT * FROM av WHERE party IN {tuple(_USE)}) a JOIN ok ON ok.o_orderkey = a.o_orderkey AND ok.whole, (VALUES {', '.join(f'({j})' for j in NEW)}) v(j) GROUP BY a.o_orderkey, j
UNION ALL SELECT av.o_orderkey, CAST(party AS INT), y, false FROM av JOIN ok ON ok.o_orderkey = av.o_orderkey AND NOT ok.whole)"""


def there(spark, d):
    """Shares of orders at five parties, of which a keyed hash loses some."""
    got = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("party").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long") % 10 < 8
    return sharing.share(orders(spark, d), "s", ["o_orderkey"], FIVE).where(got)


@query(f"WITH {shares_sql(5)} SELECT o_orderkey, CAST(j AS INT) AS party, {msum(mul('y', _TARGET))} AS y FROM sh, (VALUES {', '.join(f'({j})' for j in NEW)}) v(j) WHERE party IN {tuple(_USE)} GROUP BY o_orderkey, j")
def committee_change_reshare(spark, d):
    """Members 2 and 3, the lowest who stay, send to the new committee."""
    return sharing.reshare(sharing.share(orders(spark, d), "s", ["o_orderkey"], FIVE), ["o_orderkey"], FIVE, OLD, NEW)


@query(f"WITH {_KEPT} SELECT o_orderkey, party, y, reshared FROM rk")
def reshare_with_fallback(spark, d):
    return recovery.reshare_or_keep(there(spark, d), ["o_orderkey"], FIVE, OLD, NEW)


@query(f"WITH {_KEPT}, s AS (SELECT DISTINCT o_orderkey, reshared FROM rk) SELECT o.o_custkey AS key, count(*) AS scalars, CAST(count_if(reshared) AS BIGINT) AS reshared, CASE WHEN bool_and(reshared) THEN 'RESHARED' WHEN bool_or(reshared) THEN 'PARTIAL' ELSE 'KEPT' END AS status FROM s JOIN orders o ON o.o_orderkey = s.o_orderkey GROUP BY o.o_custkey")
def reshare_keys(spark, d):
    """The outcome by key, a customer's orders being one key's scalars."""
    rows = recovery.reshare_or_keep(there(spark, d), ["o_orderkey"], FIVE, OLD, NEW).groupBy("o_orderkey").agg(F.bool_or("reshared").alias("r"))
    own = rows.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key")), "o_orderkey")
    status = F.when(F.bool_and("r"), "RESHARED").when(F.bool_or("r"), "PARTIAL").otherwise("KEPT")
    return own.groupBy("key").agg(F.count("*").alias("scalars"), F.count_if("r").alias("reshared"), status.alias("status"))


_CAN = "WITH a AS (SELECT o_orderkey, CAST(count_if(CAST(concat('0x', substr(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(party AS VARCHAR))), 1, 8)) AS BIGINT) % 10 < 8) AS BIGINT) AS available FROM orders, range(1, 6) r(party) GROUP BY o_orderkey) SELECT available, count(*) AS scalars, available >= 2 AS feasible FROM a GROUP BY available"


@query(_CAN)
def reshare_feasible(spark, d):
    """How many scalars have how many shares, and whether those suffice."""
    every = table(spark, d, "orders").select("o_orderkey").join(there(spark, d).groupBy("o_orderkey").agg(F.count("*").alias("n")), "o_orderkey", "left")
    return every.groupBy(F.coalesce("n", F.lit(0)).cast("long").alias("available")).agg(F.count("*").alias("scalars")).withColumn("feasible", F.col("available") >= FIVE.t + 1)


_SHAPES = [("w", 0, 10, 64)]


@query(f"WITH {X}, {MEANS} SELECT CAST(i * 64 + j AS BIGINT) AS pos, layer, CAST(i AS INT) AS i, CAST(j AS INT) AS j, w AS y FROM pr")
def weights_flatten(spark, d):
    """Weights (each label's mean vector) to places in one vector, and back by arithmetic on the shapes."""
    flat = model.means(vectors(spark, d, S)).select(model.flat_place(_SHAPES).alias("pos"), F.col("v").alias("y"))
    return model.unflattened(flat, _SHAPES)


_T, _S = 12, 18


@query(f"WITH {_TL} SELECT event_id, kind, n_active, {2 * (_T + _S - 1)} < n_active AS safe, CASE kind WHEN 'drop' THEN CASE WHEN {2 * (_T + _S - 1)} < n_active THEN 'continue' ELSE 'pause_reshare' END WHEN 'join' THEN 'barrier_redistribute_bump' ELSE CASE WHEN {2 * (_T + _S - 1)} < n_active THEN 'resume' ELSE 'stay_paused' END END AS action FROM t")
def recovery_decisions(spark, d):
    return recovery.decisions(timeline(spark, d), "kind", _T, _S).select("event_id", "kind", "n_active", "safe", "action")


@query(f"""WITH {_TL}, a AS (SELECT *, kind = 'drop' AND NOT {2 * (_T + _S - 1)} < n_active AS pause, kind = 'reshare_complete' AND {2 * (_T + _S - 1)} < n_active AS resume FROM t),
n AS (SELECT *, CAST(count_if(pause) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq, first_value(CASE WHEN resume THEN ts END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM a)
SELECT event_id, seq, n_active, round(epoch_us(r - ts) / 1e6, 3) AS wall_sec, r IS NOT NULL AS success FROM n WHERE pause""")
def recovery_events(spark, d):
    """Every pause with how long it took until a resume."""
    own = recovery.decisions(timeline(spark, d), "kind", _T, _S)
    return recovery.recoveries(own, "ts", "event_id", membership.spans(table(spark, d, "events"), "ts"))


@query(f"WITH {_TL} SELECT DISTINCT n_active FROM t")
def active_counts(spark, d):
    return timeline(spark, d).select("n_active").distinct()


@query("SELECT user_id AS node, count(*) AS marks, max(ts) AS last_failed FROM events WHERE event_type = 'error' GROUP BY user_id")
def immediate_failures(spark, d):
    """Nodes that an error marks as failed at once, without waiting for a silence."""
    return table(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("node")).agg(F.count("*").alias("marks"), F.max("ts").alias("last_failed"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'SYNC' WHEN 'error' THEN 'RECONSTRUCT' WHEN 'purchase' THEN 'SHARE' ELSE 'VECTOR' END AS route, CASE WHEN event_id % 4 = 0 THEN true ELSE event_id % 4 = 2 END AS fresh, user_id % 6 + 1 IN (1, 2, 4) AND user_id % 6 + 1 <> 2 AS to_peer, event_type = 'error' AND value > 50 OR CASE WHEN event_id % 3 = 0 THEN true ELSE false END AS transient FROM events")
def message_routing(spark, d):
    """What happens to a message: its handler, whether its epoch passes, whether the peer is an active
    one, and whether a failure of it is worth another try."""
    own = table(spark, d, "events")
    route = F.when(F.col("event_type") == "signup", "SYNC").when(F.col("event_type") == "error", "RECONSTRUCT").when(F.col("event_type") == "purchase", "SHARE").otherwise("VECTOR")
    epoch = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4)
    kind = F.when((F.col("event_type") == "error") & (F.col("value") > 50), "timeout").otherwise("other")
    text = F.when(F.col("event_id") % 3 == 0, "Connection refused by host").otherwise("bad request")
    return own.select("event_id", route.alias("route"), messages.current_epoch(epoch, 2).alias("fresh"), messages.active_peer(F.col("user_id") % 6 + 1, [1, 2, 4], 2).alias("to_peer"), messages.transient(kind, text).alias("transient"))


_PAIR = "CASE WHEN greatest(o_orderkey * 3, CAST(round(o_totalprice * 10000) AS BIGINT)) > 4294967295 THEN 8 ELSE 4 END"


@query(f"SELECT o_orderkey, name, v, {_PAIR} AS width FROM (SELECT *, unnest(['d', 'e']) AS name, unnest([o_orderkey * 3, CAST(round(o_totalprice * 10000) AS BIGINT)]) AS v FROM orders)")
def vector_pairs(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", F.array(F.col("o_orderkey") * 3).alias("l"), F.array(fd.fixed(F.col("o_totalprice"), 10000)).alias("r"))
    return messages.pair_rows(own, ["o_orderkey"], "l", "r").select("o_orderkey", "name", F.get("v", F.lit(0)).alias("v"), "width")


@query("SELECT conv_id, turn, octet_length(encode(concat('{\"n\":', length(text), ',\"type\":\"', role, '\"}'))) + 8 * length(text) + 4 AS bytes FROM conversations")
def binary_messages(spark, d):
    """Bytes of messages with a JSON header and 8 bytes a value behind it."""
    n = F.char_length("text")
    header = F.to_json(F.struct(n.alias("n"), F.col("role").alias("type")))
    return table(spark, d, "conversations").select("conv_id", "turn", messages.framed(header, n.cast("long") * 8).cast("long").alias("bytes"))


@query("SELECT conv_id, count(*) AS appended, count(DISTINCT role) AS senders, min(turn) AS first, count(DISTINCT role) >= 2 AS ready FROM conversations GROUP BY conv_id")
def share_mailbox(spark, d):
    own = table(spark, d, "conversations")
    return messages.mailbox(own, "conv_id", "role", "turn").join(messages.enough(own, "conv_id", "role", 2).drop("parties"), "conv_id")


@query("SELECT conv_id, role, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def mailbox_first(spark, d):
    return messages.first_of_each(table(spark, d, "conversations"), "conv_id", "role", "turn").select("conv_id", "role", "turn")


@query("WITH c AS (SELECT DISTINCT event_type AS committee, user_id AS member FROM events), r AS (SELECT committee, member, row_number() OVER (PARTITION BY committee ORDER BY member) AS place FROM c) SELECT committee, member, place, place - 1 AS connects FROM r")
def committee_members(spark, d):
    """Members in order with how many before them they connect to: each to the ones ahead only."""
    return membership.placed(table(spark, d, "events").select(F.col("event_type").alias("committee"), F.col("user_id").alias("member")), "committee", "member").withColumn("connects", F.col("place") - 1)


_LOST = "CAST(concat('0x', substr(sha256(concat_ws('|', 'lost', CAST(o_orderkey AS VARCHAR), CAST(sender AS VARCHAR), CAST(party AS VARCHAR))), 1, 8)) AS BIGINT) % 20 = 0"


@query(f"""WITH {shares_sql(3)}, m AS (SELECT o_orderkey, sender, party, {mul(h("'refresh'", 'o_orderkey', 'sender', 1), 'party')} AS part FROM orders, range(1, 4) a(sender), range(1, 4) b(party)),
g AS (SELECT o_orderkey, party, {msum('part')} AS d, count(*) AS n FROM m WHERE NOT {_LOST} GROUP BY o_orderkey, party)
SELECT sh.o_orderkey, CAST(sh.party AS INT) AS party, CASE WHEN coalesce(n, 0) = 3 THEN (y + d) % {P} ELSE y END AS y, coalesce(n, 0) = 3 AS complete FROM sh LEFT JOIN g ON g.o_orderkey = sh.o_orderkey AND g.party = sh.party""")
def refresh_by_messages(spark, d):
    """A refresh as messages, of which a keyed hash loses some: those whose receivers miss one keep theirs."""
    one = FieldSpec()
    shares = sharing.share(orders(spark, d), "s", ["o_orderkey"], one)
    lost = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("lost"), *(F.col(c).cast("string") for c in ("o_orderkey", "sender", "party"))).cast("binary"), 256), 1, 8), 16, 10).cast("long") % 20 == 0
    sent = sharing.refresh_messages(table(spark, d, "orders"), ["o_orderkey"], one).where(~lost)
    return sharing.refresh_received(shares, sent, ["o_orderkey"], one)
