"""A store of several nodes, versions of weights, minibatches and datasets in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import field as fd
from ..operators import cluster, kv, membership, model, sharing
from ..sources.tables import table, vectors
from ..spec import FieldSpec
from .algebra_queries import logits
from .registry import MEANS, MLP, P, S, X, fix, h, mod, mul, query
from .run_queries import _LOG, log

ONE = FieldSpec()
NODES = [1, 2, 3, 4, 5]
NEED = cluster.majority(len(NODES))
_GOT = "CAST(concat('0x', substr(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(node AS VARCHAR))), 1, 8)) AS BIGINT) % 10 < 8"
_SENT = f"{_LOG}, s AS (SELECT g.*, CAST(node AS INT) AS node_id, {_GOT} AS delivered FROM g, range(1, 6) r(node))"
_HELD = "hd AS (SELECT key, node_id, version, value FROM s WHERE delivered QUALIFY row_number() OVER (PARTITION BY key, node_id ORDER BY version DESC, ts, o_orderkey) = 1)"


def sent(spark, d):
    """Each write goes to five nodes; a keyed hash decides which of them it reaches."""
    got = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("node_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long") % 10 < 8
    return cluster.to_nodes(log(spark, d), NODES, got)


@query(f"""WITH {_SENT}, a AS (SELECT *, delivered AND coalesce(version > max(CASE WHEN delivered THEN version END) OVER (PARTITION BY key, node_id ORDER BY ts, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM s)
SELECT o_orderkey, key, version, CAST(count_if(accepted) AS BIGINT) AS acks, count_if(accepted) >= {NEED} AS ok FROM a GROUP BY o_orderkey, key, version""")
def kvs_quorum_put(spark, d):
    return cluster.quorum_put(sent(spark, d), "key", ["ts", "o_orderkey"], ["o_orderkey", "key", "version"], NEED)


@query(f"""WITH RECURSIVE {_SENT}, n AS (SELECT key, node_id, version, o_orderkey, row_number() OVER (PARTITION BY key, node_id ORDER BY ts, o_orderkey) AS seq, CASE WHEN delivered THEN CASE WHEN version % 2 = 0 THEN 0 ELSE version - 1 END END AS expected FROM s),
f AS (SELECT key, node_id, seq, o_orderkey, coalesce(expected IN (0, -1), false) AS success, CASE WHEN expected IN (0, -1) THEN version END AS current FROM n WHERE seq = 1
UNION ALL SELECT n.key, n.node_id, n.seq, n.o_orderkey, coalesce(CASE WHEN f.current IS NULL THEN n.expected IN (0, -1) ELSE n.expected = f.current AND n.version > n.expected END, false),
CASE WHEN coalesce(CASE WHEN f.current IS NULL THEN n.expected IN (0, -1) ELSE n.expected = f.current AND n.version > n.expected END, false) THEN n.version ELSE f.current END FROM f JOIN n ON n.key = f.key AND n.node_id = f.node_id AND n.seq = f.seq + 1)
SELECT o_orderkey, CAST(count_if(success) AS BIGINT) AS acks, count_if(success) >= {NEED} AS ok FROM f GROUP BY o_orderkey""")
def kvs_quorum_cas(spark, d):
    own = sent(spark, d).withColumn("expected", F.when(F.col("version") % 2 == 0, F.lit(0)).otherwise(F.col("version") - 1))
    return cluster.quorum_cas(own, "key", ["ts"], "o_orderkey", NEED)


@query(f"WITH {_SENT}, {_HELD}, f AS (SELECT key, node_id, version, value FROM hd WHERE version >= 40 QUALIFY row_number() OVER (PARTITION BY key ORDER BY node_id) = 1) SELECT c.c_custkey AS key, f.node_id, f.version, f.value FROM customer c LEFT JOIN f ON f.key = c.c_custkey")
def kvs_cluster_get(spark, d):
    held = cluster.replicas(sent(spark, d), "key", ["ts", "o_orderkey"])
    return cluster.read_first(held, table(spark, d, "customer").select(F.col("c_custkey").alias("key")), "key", 40)


@query(f"WITH {_SENT}, {_HELD} SELECT key, count(*) AS nodes, max(version) AS newest, min(version) AS oldest, count_if(version = m) AS up_to_date FROM (SELECT *, max(version) OVER (PARTITION BY key) AS m FROM hd) GROUP BY key")
def kvs_replica_lag(spark, d):
    """How many nodes hold the newest version that any node holds."""
    held = cluster.replicas(sent(spark, d), "key", ["ts", "o_orderkey"])
    by = held.groupBy("key", "version").agg(F.count("*").alias("same"))
    return by.groupBy("key").agg(F.sum("same").alias("nodes"), F.max("version").alias("newest"), F.min("version").alias("oldest"), F.max_by("same", "version").alias("up_to_date"))


#: Weights in the store: a vector is a put of the weights of its label's layer.
_PUT = "p AS (SELECT concat('weights/', label, '/', vec_id // 100, '/current') AS key, vec_id, vec_id % 37 AS version, embedding FROM embeddings)"


def _layer():
    """A layer's name: a label and a block of its vectors, so layers grow in number with the table."""
    return F.concat(F.col("label").cast("string"), F.lit("/"), F.expr("vec_id div 100").cast("string"))


def puts(spark, d):
    return table(spark, d, "embeddings").select(F.concat(F.lit("weights/"), _layer(), F.lit("/current")).alias("key"), "vec_id", (F.col("vec_id") % 37).alias("version"), F.col("embedding").alias("value"))


@query(f"WITH {_PUT}, c AS (SELECT key, version, embedding FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, vec_id) = 1), u AS (SELECT key, version, unnest(range(0, 64)) AS j, {fix('unnest(embedding)')} AS y FROM c WHERE version >= 3) SELECT key, version, CAST(j AS INT) AS j, y FROM u")
def weights_get(spark, d):
    """The current weights of each layer at version 3 or newer, in fixed point."""
    own = kv.latest(puts(spark, d), ["key"], ["vec_id"]).where("version >= 3")
    return own.select("key", "version", F.posexplode(F.transform("value", lambda v: fd.fixed(v, S))).alias("j", "y"))


@query(f"WITH {_PUT} SELECT vec_id, concat('weights/v', version) AS versioned_key, coalesce(version > max(version) OVER (PARTITION BY key ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM p")
def weights_put(spark, d):
    own = kv.accepted(puts(spark, d), ["key"], ["vec_id"])
    return own.select("vec_id", F.concat(F.lit("weights/v"), F.col("version").cast("string")).alias("versioned_key"), "accepted")


_COMMIT = """WITH RECURSIVE q AS (SELECT concat(label, '/', vec_id // 100) AS layer, vec_id, CAST(vec_id % 5 + (vec_id // 20) % 400 AS BIGINT) AS version, row_number() OVER (PARTITION BY concat(label, '/', vec_id // 100) ORDER BY vec_id) AS seq FROM embeddings),
f AS (SELECT layer, seq, vec_id, version, version - 1 IN (0, -1) AS success, CASE WHEN version - 1 IN (0, -1) THEN version END AS current FROM q WHERE seq = 1
UNION ALL SELECT q.layer, q.seq, q.vec_id, q.version, CASE WHEN f.current IS NULL THEN q.version - 1 IN (0, -1) ELSE q.version - 1 = f.current END,
CASE WHEN CASE WHEN f.current IS NULL THEN q.version - 1 IN (0, -1) ELSE q.version - 1 = f.current END THEN q.version ELSE f.current END FROM f JOIN q ON q.layer = f.layer AND q.seq = f.seq + 1)"""


def attempts(spark, d):
    """Commits of a layer's next version that expect the one before."""
    version = (F.col("vec_id") % 5 + F.expr("vec_id div 20") % 400).cast("long")
    return table(spark, d, "embeddings").select(_layer().alias("layer"), "label", "vec_id", version.alias("version"), (version - 1).alias("expected"))


@query(f"{_COMMIT} SELECT layer, vec_id, version, success, current FROM f")
def weights_put_cas(spark, d):
    return kv.compare_and_set(attempts(spark, d).drop("label"), "layer", ["vec_id"]).select("layer", "vec_id", "version", "success", "current")


def _by_label(sql: str) -> str:
    """The same commits, a label's being one model's."""
    return sql.replace("concat(label, '/', vec_id // 100)", "label").replace("label AS layer", "label").replace("layer", "label")


@query(f"{_by_label(_COMMIT)} SELECT label, max(version) AS version, max(CASE WHEN vec_id % 3 <> 0 THEN version END) AS mirror_version, count(*) AS commits, coalesce(max(CASE WHEN vec_id % 3 <> 0 THEN version END) < max(version), true) AS repaired FROM f WHERE success GROUP BY label")
def model_commits(spark, d):
    """All commits of a label in one order, over the whole table."""
    return cluster.commits(attempts(spark, d), "label", ["vec_id"], F.col("vec_id") % 3 != 0)


@query("""WITH l AS (SELECT event_id % 500 AS step, CASE WHEN event_type IN ('view', 'click') THEN 'inputs' ELSE 'targets' END AS side, event_id // 500 AS version, event_id, value FROM events),
b AS (SELECT step, side, version, value FROM l QUALIFY row_number() OVER (PARTITION BY step, side ORDER BY version DESC, event_id DESC) = 1)
SELECT i.step, i.value AS inputs, t.value AS targets, greatest(i.version, t.version) AS version FROM b i JOIN b t ON i.step = t.step AND i.side = 'inputs' AND t.side = 'targets'""")
def minibatch_load(spark, d):
    side = F.when(F.col("event_type").isin("view", "click"), "inputs").otherwise("targets")
    own = table(spark, d, "events").select((F.col("event_id") % 500).alias("step"), side.alias("side"), F.expr("event_id div 500").alias("version"), "event_id", "value")
    return cluster.side_by_side(own, "step", "side", "inputs", "targets", ["event_id"])


@query("""WITH e AS (SELECT event_id, ts, concat('membership/epoch/', user_id % 5 + 1) AS key, hour(ts) AS epoch FROM events WHERE event_type = 'signup')
SELECT key, max(epoch) AS epoch, count(*) AS puts, CAST(count_if(a) AS BIGINT) AS accepted FROM (SELECT key, epoch, coalesce(epoch > max(epoch) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS a FROM e) GROUP BY key""")
def epoch_record(spark, d):
    """The epoch that each node has on record: a put of an epoch counts if it is higher."""
    own = table(spark, d, "events").where("event_type = 'signup'").select("event_id", "ts", F.concat(F.lit("membership/epoch/"), (F.col("user_id") % 5 + 1).cast("string")).alias("key"), F.hour("ts").cast("long").alias("version"))
    taken = kv.accepted(own, ["key"], ["ts", "event_id"])
    return taken.groupBy("key").agg(F.max("version").alias("epoch"), F.count("*").alias("puts"), F.count_if("accepted").alias("accepted"))


@query(f"WITH {X}, f AS (SELECT vec_id, j, {mod('y')} AS s FROM x UNION ALL SELECT vec_id, 64, CAST(label AS BIGINT) FROM embeddings) SELECT concat('data/train/', vec_id) AS key, CAST(j AS INT) AS j, CAST(party AS INT) AS party, (s + {mul(h(chr(39) + 'dataset' + chr(39), 'vec_id', 'j', 1), 'party')}) % {P} AS y FROM f, range(1, 4) r(party)")
def dataset_ingest(spark, d):
    """Features and, after them, the label of every sample, shared for all parties under its key."""
    own = vectors(spark, d, S).select("vec_id", F.posexplode(F.concat(F.transform("x", lambda v: fd.field(v, P)), F.array(F.col("label").cast("long")))).alias("j", "s"))
    own = sharing.share(own, "s", ["vec_id", "j"], ONE, "dataset")
    return own.select(F.concat(F.lit("data/train/"), F.col("vec_id").cast("string")).alias("key"), "j", "party", "y")


@query("SELECT party, count(*) AS samples, CAST(count(*) * 65 AS BIGINT) AS cells, true AS complete FROM (SELECT vec_id, unnest([1, 2, 3]) AS party FROM embeddings) GROUP BY party")
def dataset_receive(spark, d):
    """What each party received against the row of metadata that goes ahead: samples times width."""
    got = dataset_ingest(spark, d).groupBy("party", "key").agg(F.count("*").alias("n"))
    meta = table(spark, d, "embeddings").agg(F.count("*").alias("samples"))  # one row
    own = got.groupBy("party").agg(F.count("*").alias("samples"), F.sum("n").alias("cells"), F.min("n").alias("least"))
    return own.join(F.broadcast(meta.withColumnRenamed("samples", "all")), F.lit(True)).select("party", "samples", "cells", ((F.col("samples") == F.col("all")) & (F.col("least") == 65)).alias("complete"))


@query(f"WITH {X}, {MEANS} SELECT layer, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(party AS INT) AS party, ({mod('w')} + {mul(h(chr(39) + 'weights' + chr(39), 'layer', 'i', 'j', 1), 'party')}) % {P} AS y FROM pr, range(1, 4) p(party)")
def weights_share(spark, d):
    """A layer's weights (each label's mean vector), shared by one dealer for all parties."""
    own = model.means(vectors(spark, d, S)).withColumn("s", fd.field(F.col("v"), P)).drop("v")
    return sharing.share(own, "s", ["layer", "i", "j"], ONE, "weights")


@query(f"WITH {MLP} SELECT vec_id AS slot, CAST(class AS INT) AS class, CAST(party AS INT) AS party, ({mod('y')} + {mul(h(chr(39) + 'logits' + chr(39), 'vec_id', 'class', 1), 'party')}) % {P} AS y FROM z2, range(1, 4) p(party)")
def inference_upload(spark, d):
    """Shares of every sample's logits, as parties send them to a client."""
    own = logits(spark, d).select(F.col("vec_id").alias("slot"), F.posexplode_outer("z2").alias("class", "s")).withColumn("s", fd.field(F.col("s"), P))
    return sharing.share(own, "s", ["slot", "class"], ONE, "logits")


@query("WITH m AS (SELECT DISTINCT CAST(date_trunc('day', ts) AS DATE) AS day, user_id % 7 + 1 AS node FROM events WHERE event_type = 'signup'), a AS (SELECT DISTINCT CAST(date_trunc('day', ts) AS DATE) AS day FROM events) SELECT CAST(a.day AS VARCHAR) AS day, CASE WHEN count(m.node) < 2 THEN '1,2,3,4,5,6,7' ELSE string_agg(CAST(m.node AS VARCHAR), ',' ORDER BY m.node) END AS nodes FROM a LEFT JOIN m ON m.day = a.day GROUP BY a.day")
def active_nodes(spark, d):
    """The nodes that joined on a day, or all of 1..7 where fewer than two did."""
    node = F.when(F.col("event_type") == "signup", (F.col("user_id") % 7 + 1).cast("int"))
    own = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.collect_set(node).alias("s"))  # seven at most
    return own.select("day", F.array_join(membership.active_or_all(F.col("s"), 7, 2).cast("array<string>"), ",").alias("nodes"))
