"""Store, membership, messages, logs and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import field as fd
from ..operators import kv, membership, metrics
from ..sources.tables import table
from ..streaming import folds, streams
from .registry import query

VERSION = "o_orderkey % 50"
_LOG = f"g AS (SELECT o_orderkey, o_custkey AS key, o_orderdate AS ts, {VERSION} AS version, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders)"
_CUR = f"{_LOG}, c AS (SELECT key, version, value FROM g QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, ts, o_orderkey) = 1)"


def log(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") % 50).alias("version"), fd.fixed(F.col("o_totalprice"), 100).alias("value"))


def current(spark, d):
    return kv.latest(log(spark, d), ["key"], ["ts", "o_orderkey"])


@query(f"WITH {_LOG} SELECT o_orderkey, key, version, coalesce(version > max(version) OVER (PARTITION BY key ORDER BY ts, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM g")
def kvs_put_accepted(spark, d):
    return kv.accepted(log(spark, d), ["key"], ["ts", "o_orderkey"]).select("o_orderkey", "key", "version", "accepted")


@query(f"WITH {_CUR} SELECT key, version, value FROM c")
def kvs_latest(spark, d):
    return current(spark, d)


@query(f"WITH {_CUR} SELECT k.c_custkey AS key, c.version, c.value FROM customer k LEFT JOIN c ON c.key = k.c_custkey AND c.version >= 40")
def kvs_get_min_version(spark, d):
    return kv.fresh(current(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("key")), ["key"], 40)


def statuses(spark, d, customers):
    own = kv.fresh(current(spark, d), customers.select(F.col("c_custkey").alias("key")), ["key"], 0)
    status = F.when(F.col("version").isNull(), "MISSING").when(F.col("version") < F.col("key") % 50, "STALE").otherwise("OK")
    return own.withColumn("status", status)


@query(f"WITH {_CUR} SELECT k.c_custkey AS key, c.version, c.value, CASE WHEN c.key IS NULL THEN 'MISSING' WHEN c.version < k.c_custkey % 50 THEN 'STALE' ELSE 'OK' END AS status FROM customer k LEFT JOIN c ON c.key = k.c_custkey")
def kvs_get_batch(spark, d):
    return statuses(spark, d, table(spark, d, "customer"))


@query(f"""WITH RECURSIVE {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, o_orderkey) AS seq, CASE WHEN version % 2 = 0 THEN 0 ELSE version - 1 END AS expected FROM g),
f AS (SELECT key, seq, o_orderkey, expected IN (0, -1) AS success, CASE WHEN expected IN (0, -1) THEN version END AS current FROM n WHERE seq = 1
UNION ALL SELECT n.key, n.seq, n.o_orderkey, CASE WHEN f.current IS NULL THEN n.expected IN (0, -1) ELSE n.expected = f.current AND n.version > n.expected END,
CASE WHEN CASE WHEN f.current IS NULL THEN n.expected IN (0, -1) ELSE n.expected = f.current AND n.version > n.expected END THEN n.version ELSE f.current END FROM f JOIN n ON n.key = f.key AND n.seq = f.seq + 1)
SELECT key, o_orderkey, success, current FROM f""")
def kvs_cas(spark, d):
    own = log(spark, d).withColumn("expected", F.when(F.col("version") % 2 == 0, F.lit(0)).otherwise(F.col("version") - 1))
    return kv.compare_and_set(own, "key", ["ts", "o_orderkey"]).select("key", "o_orderkey", "success", "current")


_DROP = "CAST(concat('0x', substr(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(node AS VARCHAR))), 1, 8)) AS BIGINT) % 10 < 6"


@query(f"WITH {_LOG} SELECT key, version, o_orderkey, CAST(count_if({_DROP}) AS BIGINT) AS acks, count_if({_DROP}) >= 3 AS ok FROM g, range(1, 6) r(node) GROUP BY key, version, o_orderkey")
def kvs_quorum(spark, d):
    nodes = log(spark, d).withColumn("node_id", F.explode(F.lit([1, 2, 3, 4, 5])))
    kept = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("node_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long") % 10 < 6
    return kv.quorum(nodes.withColumn("accepted", kept), ["key", "version", "o_orderkey"], 5)


@query("SELECT event_type, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS members, count(user_id) AS n, min(user_id) AS first, max(user_id) AS last FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY event_type")
def committee(spark, d):
    """Every committee's members in order, each once, with its size and ends."""
    m = membership.committee(F.collect_list("user_id"))
    own = table(spark, d, "events").select("event_type", "user_id").distinct().groupBy("event_type").agg(m.alias("m"))  # ids of one committee
    members = F.when(F.size("m") > 0, F.array_join(F.col("m").cast("array<string>"), ","))
    return own.select("event_type", members.alias("members"), F.size("m").cast("long").alias("n"), F.array_min("m").alias("first"), F.array_max("m").alias("last"))


@query("""WITH m AS (SELECT DISTINCT date_trunc('day', ts) AS day, user_id FROM events), p AS (SELECT a.day, count(b.user_id) AS stayed, count(*) AS members FROM m a LEFT JOIN m b ON b.user_id = a.user_id AND b.day = a.day - INTERVAL 1 DAY GROUP BY a.day)
SELECT CAST(day AS VARCHAR) AS day, stayed, members FROM p""")
def committee_overlap(spark, d):
    m = table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id").distinct()
    before = m.select(F.date_add("day", 1).alias("day"), "user_id", F.lit(1).alias("was"))
    own = m.join(before, ["day", "user_id"], "left").groupBy("day").agg(F.count("was").alias("stayed"), F.count("*").alias("members"))
    return own.withColumn("day", F.concat(F.col("day").cast("string"), F.lit(" 00:00:00")))


@query("""WITH n AS (SELECT user_id AS node, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx, (SELECT max(ts) FROM events) AS fin FROM events)
SELECT node, ts + INTERVAL 36 HOUR AS failed_at, nx AS recovered_at FROM n WHERE coalesce(nx, fin) > ts + INTERVAL 36 HOUR""")
def failure_detection(spark, d):
    return membership.failures(table(spark, d, "events").withColumnRenamed("user_id", "node"), "node", "ts", 36)


_KIND = "CASE event_type WHEN 'signup' THEN 'join' WHEN 'error' THEN 'drop' WHEN 'purchase' THEN 'reshare_complete' END"
_TL = f"""k AS (SELECT event_id, ts, user_id, {_KIND} AS kind FROM events WHERE event_type IN ('signup', 'error', 'purchase')),
s AS (SELECT *, CASE kind WHEN 'join' THEN 1 WHEN 'drop' THEN 0 END AS st FROM k),
w AS (SELECT *, coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM s),
t AS (SELECT event_id, ts, kind, CAST(sum(coalesce(st, was) - was) OVER o AS BIGINT) AS n_active, CAST(coalesce(last_value(CASE kind WHEN 'drop' THEN 1 WHEN 'reshare_complete' THEN 0 END IGNORE NULLS) OVER o, 0) AS INT) AS paused, CAST(count_if(kind = 'join') OVER o AS BIGINT) AS epoch FROM w WINDOW o AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


def timeline(spark, d):
    kind = F.when(F.col("event_type") == "signup", "join").when(F.col("event_type") == "error", "drop").when(F.col("event_type") == "purchase", "reshare_complete")
    own = table(spark, d, "events").select("event_id", "ts", "user_id", kind.alias("kind")).where("kind is not null")
    return membership.timeline(own, "ts", "event_id", "user_id", "kind")


@query(f"WITH {_TL} SELECT event_id, n_active, paused, epoch FROM t")
def membership_timeline(spark, d):
    return timeline(spark, d).select("event_id", "n_active", "paused", "epoch")


@query("WITH e AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'PAUSED_RESHARE' WHEN 'purchase' THEN 'TRAINING' END AS to_state FROM events WHERE event_type IN ('error', 'purchase')), f AS (SELECT event_id, coalesce(lag(to_state) OVER (ORDER BY ts, event_id), 'TRAINING') AS from_state, to_state FROM e) SELECT * FROM f WHERE from_state <> to_state")
def state_transitions(spark, d):
    """Where the state changes: the state before is the last one so far, by spans of time."""
    to = F.when(F.col("event_type") == "error", "PAUSED_RESHARE").when(F.col("event_type") == "purchase", "TRAINING")
    own = table(spark, d, "events").select("event_id", "ts", to.alias("to_state")).where("to_state is not null").withColumn("span", membership.spans(table(spark, d, "events"), "ts"))
    ends = own.groupBy("span").agg(F.max_by("to_state", F.struct("ts", "event_id")).alias("end"))
    starts = ends.select("span", F.coalesce(F.lag("end").over(Window.orderBy("span")), F.lit("TRAINING")).alias("start"))
    w = Window.partitionBy("span").orderBy("ts", "event_id")
    own = own.withColumn("before", F.lag("to_state").over(w)).join(starts, "span")
    return own.select("event_id", F.coalesce("before", "start").alias("from_state"), "to_state").where("from_state <> to_state")


@query("SELECT conv_id AS tag, string_agg(role, ',' ORDER BY role) AS got, count_if(role IN ('user', 'assistant')) = 2 AS passed FROM (SELECT DISTINCT conv_id, role FROM conversations) GROUP BY conv_id")
def barrier_status(spark, d):
    return membership.barriers(table(spark, d, "conversations").withColumnRenamed("conv_id", "tag"), "tag", "role", ["user", "assistant"])


@query("SELECT conv_id, role, sha256(text) AS last_text_hash FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def mailbox_latest(spark, d):
    own = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max_by(F.sha2(F.col("text").cast("binary"), 256), "turn").alias("last_text_hash"))
    return own


@query("SELECT role, CAST(sum(octet_length(encode(text)) + 4) AS BIGINT) AS bytes, count(*) AS n FROM conversations GROUP BY role")
def message_volume(spark, d):
    """Bytes of length-prefixed messages."""
    return table(spark, d, "conversations").groupBy("role").agg(F.sum(F.octet_length("text") + 4).cast("long").alias("bytes"), F.count("*").alias("n"))


_LINES = "ln AS (SELECT event_id, user_id % 5 + 1 AS node, event_type, value, concat('[BENCHMARK] role=node', user_id % 5 + 1, ' phase=', event_type, ' wall_sec=', printf('%.6f', value)) AS line FROM events)"


def lines(spark, d):
    own = table(spark, d, "events")
    role = F.concat(F.lit("node"), (F.col("user_id") % 5 + 1).cast("string"))
    return own.select("event_id", metrics.encode(role, F.col("event_type"), F.col("value")).alias("line"))


@query(f"WITH {_LINES} SELECT event_id, line FROM ln")
def log_encode(spark, d):
    return lines(spark, d)


@query("SELECT event_id, concat('node', user_id % 5 + 1) AS role, event_type AS phase, CAST(printf('%.6f', value) AS DOUBLE) AS wall_sec FROM events")
def log_parse(spark, d):
    own = lines(spark, d).select("event_id", metrics.parse(F.col("line")).alias("m"))
    return own.select("event_id", F.col("m.role").alias("role"), F.col("m.phase").alias("phase"), F.col("m.wall_sec").cast("double").alias("wall_sec"))


def parsed(spark, d):
    return log_parse(spark, d)


@query("SELECT concat('node', user_id % 5 + 1) AS role, event_type AS phase, CAST(printf('%.6f', min_by(value, event_id)) AS DOUBLE) AS first_value, CAST(printf('%.6f', max_by(value, event_id)) AS DOUBLE) AS last_value FROM events GROUP BY ALL")
def log_first_last_wins(spark, d):
    return metrics.first_last(parsed(spark, d), ["role", "phase"], "wall_sec", "event_id")


@query("SELECT concat('node', user_id % 5 + 1) AS role, event_type AS phase, count(*) AS n, round(sum(CAST(printf('%.6f', value) AS DOUBLE)), 3) AS total, max(CAST(printf('%.6f', value) AS DOUBLE)) AS longest FROM events GROUP BY ALL")
def timing_summary(spark, d):
    return parsed(spark, d).groupBy("role", "phase").agg(F.count("*").alias("n"), F.round(F.sum("wall_sec"), 3).alias("total"), F.max("wall_sec").alias("longest"))


@query("WITH b AS (SELECT user_id % 5 + 1 AS r, sum(value) AS t FROM events GROUP BY 1) SELECT round(max(t), 3) AS critical_path, round(sum(t), 3) AS summed, count(*) AS roles, round(greatest(0.0, max(t) * 0 + sum(t) * 0 + greatest(0.0, sum(t) - max(t) * count(*))), 3) AS residual FROM b")
def run_overhead(spark, d):
    own = metrics.overhead(table(spark, d, "events").select((F.col("user_id") % 5 + 1).alias("role"), F.col("event_type").alias("phase"), F.col("value").alias("wall_sec")))
    return own.select(*(F.round(c, 3).alias(c) for c in ("critical_path", "summed", "residual")), "roles")


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day, count(*) AS samples, round(count(*) / sum(value), 6) AS per_sec, round(1000 * avg(value), 3) AS ms_each FROM events GROUP BY 1")
def throughput(spark, d):
    own = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("samples"), F.round(F.count("*") / F.sum("value"), 6).alias("per_sec"), F.round(1000 * F.avg("value"), 3).alias("ms_each"))
    return own.withColumn("day", F.concat(F.col("day").cast("string"), F.lit(" 00:00:00")))


@query("SELECT user_id % 5 + 1 AS node, count(*) AS iters, round(avg(value), 4) AS mean, max(value) AS peak, round(sum(value) / greatest(count(*), 1) / 1048576, 9) AS mb_each FROM events GROUP BY 1")
def runtime_snapshot(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 5 + 1).alias("node")).agg(F.count("*").alias("iters"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("peak"), F.round(F.sum("value") / F.greatest(F.count("*"), F.lit(1)) / 1048576, 9).alias("mb_each"))


@query("SELECT coalesce(event_type, 'total') AS category, round(sum(value), 2) AS seconds, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def prover_breakdown(spark, d):
    return table(spark, d, "events").rollup("event_type").agg(F.round(F.sum("value"), 2).alias("seconds"), F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("total")).alias("category"), "seconds", "n")


@query("SELECT event_type AS stage, round(100 * sum(value) / (SELECT sum(value) FROM events), 4) AS pct FROM events GROUP BY event_type")
def stage_shares(spark, d):
    by = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("s"))
    return by.select("stage", F.round(100 * F.col("s") / F.sum("s").over(Window.partitionBy()), 4).alias("pct"))  # one row a stage


_DAILY = "dl AS (SELECT date_trunc('day', ts) AS day, avg(value) AS loss FROM events GROUP BY 1)"


def daily(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("loss"))


@query(f"WITH {_DAILY}, g AS (SELECT day, loss, loss / lag(loss) OVER (ORDER BY day) AS growth FROM dl), f AS (SELECT *, coalesce(growth > 1.05, false) OR loss > 60 AS flag FROM g) SELECT CAST(day AS VARCHAR) AS day, round(growth, 6) AS growth, flag, bool_or(flag) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS aborted FROM f")
def stability_flags(spark, d):
    own = metrics.stability(daily(spark, d), "day", "loss", 1.05, 60)
    return own.select(F.concat(F.col("day").cast("string"), F.lit(" 00:00:00")).alias("day"), F.round("growth", 6).alias("growth"), "flag", "aborted")


@query(f"WITH {_DAILY} SELECT round(max_by(loss, day) - min_by(loss, day), 6) AS delta, count(*) AS days FROM dl")
def loss_delta(spark, d):
    return daily(spark, d).agg(F.round(F.max_by("loss", "day") - F.min_by("loss", "day"), 6).alias("delta"), F.count("*").alias("days"))


@query("""WITH r AS (SELECT label, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v)) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT label, round(sqrt(sum(v) * max(n) / count(*)), 6) AS norm, count(*) AS sampled FROM r WHERE rn <= 32 GROUP BY label""")
def grad_norm_estimate(spark, d):
    """A layer's norm over all components from its first 32 vectors, scaled to all of them."""
    own = table(spark, d, "embeddings").select("label", "vec_id", F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v).alias("v"))
    n = own.groupBy("label").agg(F.count("*").alias("n"))
    some = metrics.k_least(own, "label", "vec_id", 32).groupBy("label").agg(F.sum("v").alias("v"), F.count("*").alias("sampled"))
    return some.join(n, "label").select("label", F.round(F.sqrt(F.col("v") * F.col("n") / F.col("sampled")), 6).alias("norm"), "sampled")


@query("WITH a AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, date_trunc('month', o_orderdate) AS m FROM orders) SELECT CAST(m AS VARCHAR) AS month, CAST(count_if(k > 1) AS BIGINT) AS hits, CAST(count_if(k = 1) AS BIGINT) AS misses FROM a GROUP BY m")
def cache_hit_miss(spark, d):
    """A key's first access misses and fills the cache."""
    own = table(spark, d, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    out = own.groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.count_if(F.col("k") > 1).alias("hits"), F.count_if(F.col("k") == 1).alias("misses"))
    return out.select(F.concat(F.col("m").cast("string"), F.lit(" 00:00:00")).alias("month"), "hits", "misses")


@query("SELECT l_orderkey AS batch, substr(sha256(concat('v1:', string_agg(CAST(k AS VARCHAR), ',' ORDER BY k))), 1, 16) AS tag FROM (SELECT DISTINCT l_orderkey, l_partkey AS k FROM lineitem) GROUP BY 1")
def batch_tag(spark, d):
    """A tag for every batch over its real ids: a batch is one order's parts, as few as its lines."""
    ids = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.array_sort(F.collect_set("l_partkey")).alias("ids"))
    text = F.concat(F.lit("v1:"), F.array_join(F.col("ids").cast("array<string>"), ","))
    return ids.select("batch", F.substring(F.sha2(text.cast("binary"), 256), 1, 16).alias("tag"))


@query("SELECT o_orderkey, concat('m', o_orderkey % 7, '_grad') AS context, concat('data/train/', o_orderkey) AS sample_key, concat('weights/layer/', o_orderkey % 4) AS layer_key FROM orders")
def context_tags(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("m"), (k % 7).cast("string"), F.lit("_grad")).alias("context"), F.concat(F.lit("data/train/"), k.cast("string")).alias("sample_key"), F.concat(F.lit("weights/layer/"), (k % 4).cast("string")).alias("layer_key"))


@query("SELECT doc_id, concat('data/', CASE WHEN toxic = 1 THEN 'test' ELSE 'train' END, '/', doc_id) AS key, concat('data/batch/', doc_id // 64, '/inputs') AS inputs_key, concat('weights/v', quality, '/', doc_id % 4) AS weights_key FROM labels")
def kvs_keys(spark, d):
    """Store keys of a sample, of its minibatch and of a weight version."""
    split = F.when(F.col("toxic") == 1, "test").otherwise("train")
    text = lambda c: F.expr(c).cast("string")
    return table(spark, d, "labels").select(
        "doc_id", F.concat_ws("/", F.lit("data"), split, text("doc_id")).alias("key"), F.concat(F.lit("data/batch/"), text("doc_id div 64"), F.lit("/inputs")).alias("inputs_key"),
        F.concat(F.lit("weights/v"), text("quality"), F.lit("/"), text("doc_id % 4")).alias("weights_key"),
    )


@query("WITH b AS (SELECT sum(value) AS t FROM events WHERE event_id % 2 = 0), v AS (SELECT sum(value) AS t FROM events WHERE event_id % 2 = 1) SELECT round(100 * (v.t - b.t) / b.t, 4) AS pct FROM b, v")
def versioning_overhead(spark, d):
    """Two runs side by side: one aggregation instead of a join of their totals."""
    odd = F.col("event_id") % 2 == 1
    own = table(spark, d, "events").agg(F.sum(F.when(odd, F.col("value"))).alias("v"), F.sum(F.when(~odd, F.col("value"))).alias("b"))
    return own.select(F.round(100 * (F.col("v") - F.col("b")) / F.col("b"), 4).alias("pct"))


@query("WITH e AS (SELECT doc_id, epoch, CAST(concat('0x', substr(sha256(concat_ws('|', CAST(2026 + epoch AS VARCHAR), CAST(doc_id AS VARCHAR))), 1, 15)) AS BIGINT) AS turn FROM labels, range(2) r(epoch)), o AS (SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY turn, doc_id) - 1 AS n FROM e) SELECT CAST(epoch AS INT) AS epoch, CAST(n // 64 AS INT) AS batch, CAST(n % 64 AS INT) AS pos, doc_id AS id FROM o")
def minibatch_plan(spark, d):
    """Two epochs in keyed order, in slices of 64. Places come from bins of the hash and counts of
    the bins before, so no task ranks a whole epoch."""
    own = table(spark, d, "labels").select("doc_id", F.explode(F.lit([0, 1])).alias("epoch"))
    own = own.withColumn("turn", fd.hash60((F.col("epoch") + 2026), F.col("doc_id"))).withColumn("bin", F.shiftright("turn", 48))
    counts = own.groupBy("epoch", "bin").count()  # 4096 bins an epoch at most
    before = counts.select("epoch", "bin", (F.sum("count").over(Window.partitionBy("epoch").orderBy("bin")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("epoch", "bin").orderBy("turn", "doc_id")) - 1
    own = own.withColumn("rank", rank).join(F.broadcast(before), ["epoch", "bin"]).withColumn("n", F.col("rank") + F.col("before"))
    return own.select("epoch", F.expr("cast(n div 64 as int)").alias("batch"), (F.col("n") % 64).cast("int").alias("pos"), F.col("doc_id").alias("id"))


@query("SELECT user_id, max(ts) AS last_seen, count(*) AS beats FROM events GROUP BY user_id")
def heartbeat_stream(spark, d):
    return streams.run(streams.last_seen(streams.events(spark, d)), "heartbeats", "complete")


@query("SELECT user_id, CAST(max_by(CASE event_type WHEN 'signup' THEN 1 ELSE 0 END, ts) AS INT) AS active FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id")
def membership_stream(spark, d):
    return streams.run(streams.membership(streams.events(spark, d)), "membership", "complete")


@query("WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, count(*) AS n, max(value) AS peak FROM events GROUP BY 1) SELECT start, n, peak FROM w WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def sampler_stream(spark, d):
    return streams.run(streams.sampler(streams.events(spark, d)), "sampler")


@query("""WITH n AS (SELECT user_id AS node, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx, (SELECT max(ts) FROM events) AS fin FROM events)
SELECT node, ts + INTERVAL 36 HOUR AS failed_at, nx AS recovered_at FROM n WHERE coalesce(nx, fin) > ts + INTERVAL 36 HOUR""")
def failure_stream(spark, d):
    """The failures found as a stream, by each node's timer."""
    own = streams.run(streams.failures(streams.events(spark, d), "user_id", 36, buckets=streams.buckets(table(spark, d, "events"))), "failures")
    return own.select("node", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("failed_at", "recovered_at")))


_GRACE = "TIMESTAMP '2024-01-05'"


@query(f"""WITH n AS (SELECT user_id AS node, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx, (SELECT max(ts) FROM events) AS fin FROM events),
f AS (SELECT node, greatest(ts + INTERVAL 36 HOUR, {_GRACE}) AS failed_at, nx AS recovered_at, fin FROM n)
SELECT node, failed_at, recovered_at FROM f WHERE coalesce(recovered_at, fin) > failed_at""")
def failure_grace_stream(spark, d):
    """Failures as a stream that is muted until the grace period ends, over several micro-batches."""
    own = streams.run(streams.failures(streams.events(spark, d), "user_id", 36, 1_704_412_800_000_000, streams.buckets(table(spark, d, "events"))), "failures_grace")
    return own.select("node", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("failed_at", "recovered_at")))


@query(f"""WITH n AS (SELECT user_id AS node, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx, (SELECT max(ts) FROM events) AS fin FROM events),
f AS (SELECT node, greatest(ts + INTERVAL 36 HOUR, {_GRACE}) AS failed_at, nx AS recovered_at, fin FROM n)
SELECT node, failed_at, recovered_at FROM f WHERE coalesce(recovered_at, fin) > failed_at""")
def failure_grace(spark, d):
    beats = table(spark, d, "events").withColumnRenamed("user_id", "node")
    return membership.failures(beats, "node", "ts", 36, grace_end=F.lit("2024-01-05").cast("timestamp_ntz"))


#: A last row for replays: far behind all others, so that time moves past them and their timers.
_END = {"event_id": -1, "ts": "2100-01-01 00:00:00", "user_id": -1, "event_type": folds.TICK}


@query(f"WITH {_TL} SELECT event_id, n_active, paused, epoch FROM t")
def membership_fold_stream(spark, d):
    """membership_timeline from files that arrive out of order: nodes are folded in state, behind a
    watermark, and the running numbers follow from the table that the stream wrote."""
    stream, late = streams.replayed(table(spark, d, "events"), "ts", mixed=True, end=_END)
    kind = F.when(F.col("event_type") == "signup", "join").when(F.col("event_type") == "error", "drop").when(F.col("event_type") == "purchase", "reshare_complete").when(F.col("event_type") == folds.TICK, folds.TICK)
    deltas = streams.run(folds.membership(stream, "ts", "event_id", "user_id", kind, late, streams.buckets(table(spark, d, "events"))), "membership_fold")
    own = deltas.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    return membership.totals(own, "ts", "event_id", "kind", "delta").select("event_id", "n_active", "paused", "epoch")


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, value, event_type = 'purchase' AS take, lag(ts) OVER w AS before, lag(event_type) OVER w = 'purchase' AS taken FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, count_if(before IS NULL OR taken OR before + INTERVAL 24 HOUR < ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS box FROM e),
b AS (SELECT user_id, box, max(event_id) FILTER (take) AS by_id FROM s GROUP BY user_id, box),
p AS (SELECT user_id, box, event_type, max_by(event_id, (ts, event_id)) AS id FROM s WHERE NOT take GROUP BY user_id, box, event_type)
SELECT p.user_id AS context, p.event_type AS sender, p.id, CAST(e.value AS DOUBLE) AS value, CASE WHEN by_id IS NULL THEN 'evicted' ELSE 'taken' END AS how, by_id AS taken_by FROM p JOIN b USING (user_id, box) JOIN events e ON e.event_id = p.id""")
def mailbox_stream(spark, d):
    """A context for each user: other events put a value by their type, a purchase takes what is there,
    and what nobody takes within 24 hours of the last event is evicted."""
    stream, late = streams.replayed(table(spark, d, "events"), "ts", mixed=True, end=_END)
    kind = F.when(F.col("event_type") == "purchase", "take").otherwise(F.col("event_type"))
    own = streams.run(folds.mailbox(stream, "ts", "event_id", "user_id", kind, F.col("value"), late, 24, streams.buckets(table(spark, d, "events"))), "mailbox")
    return own.withColumn("value", F.col("value").cast("double"))
