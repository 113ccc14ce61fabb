"""Older log lines, tables of timings, and snapshots of counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import logs, metrics
from ..sources.tables import sample_order, subset, table
from .registry import query
from .run_queries import parsed

_NAMES = ", ".join(f"'{n}'" for n in logs.OLDER)
_OLD = f"ol AS (SELECT event_id, concat('node', user_id % 5 + 1) AS role, CASE WHEN event_id % 3 = 0 THEN concat('INFO ', ([{_NAMES}])[event_id % 8 + 1], ': ', printf('%.2f', value), 's') WHEN event_id % 3 = 1 THEN concat('Epoch ', event_id % 10, ' Test ', CASE WHEN event_id % 2 = 0 THEN 'Accuracy: ' ELSE 'Loss: ' END, printf('%.4f', value), CASE WHEN event_id % 2 = 0 THEN '%' ELSE '' END) ELSE concat('noise ', event_id) END AS line FROM events)"


def old_lines(spark, d):
    k = F.col("event_id")
    name = F.get(F.lit(list(logs.OLDER)), (k % 8).cast("int"))
    timing = F.concat(F.lit("INFO "), name, F.lit(": "), F.format_string("%.2f", "value"), F.lit("s"))
    even = k % 2 == 0
    metric = F.concat(F.lit("Epoch "), (k % 10).cast("string"), F.lit(" Test "), F.when(even, "Accuracy: ").otherwise("Loss: "), F.format_string("%.4f", "value"), F.when(even, "%").otherwise(""))
    line = F.when(k % 3 == 0, timing).when(k % 3 == 1, metric).otherwise(F.concat(F.lit("noise "), k.cast("string")))
    return table(spark, d, "events").select("event_id", F.concat(F.lit("node"), (F.col("user_id") % 5 + 1).cast("string")).alias("role"), line.alias("line"))


_KEY = "CASE n " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in logs.OLDER.items()) + " END"
_OLDER = f"od AS (SELECT role, {_KEY} AS key, max_by(v, event_id) AS seconds FROM (SELECT role, event_id, unnest([{_NAMES}]) AS n, line, TRY_CAST(regexp_extract(line, n || ':\\s*([0-9.]+)s', 1) AS DOUBLE) AS v FROM ol) WHERE v IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_OLD}, {_OLDER} SELECT role, key, seconds FROM od")
def older_timings(spark, d):
    return logs.older_timings(old_lines(spark, d), "role", "event_id")


_TAGGED = "tg AS (SELECT concat('node', user_id % 5 + 1) AS role, CAST(printf('%.6f', min_by(value, event_id)) AS DOUBLE) AS tagged FROM events WHERE event_type = 'signup' GROUP BY 1)"


@query(f"WITH {_OLD}, {_OLDER}, {_TAGGED} SELECT tg.role, coalesce(od.seconds, tg.tagged) AS seconds FROM tg LEFT JOIN od ON od.role = tg.role AND od.key = 'training_sec' AND od.seconds > 30")
def training_seconds(spark, d):
    """Older lines first (where they say over 30), then the first tagged one."""
    old = older_timings(spark, d).where("key = 'training_sec' and seconds > 30").select("role", "seconds")
    tagged = parsed(spark, d).where("phase = 'signup'").groupBy("role").agg(F.min_by("wall_sec", "event_id").alias("tagged"))
    return tagged.join(old, "role", "left").select("role", F.coalesce("seconds", "tagged").alias("seconds"))


@query(f"WITH {_OLD}, m AS (SELECT role, event_id, regexp_extract(line, 'Test (Accuracy|Loss):', 1) AS what, TRY_CAST(regexp_extract(line, 'Test (?:Accuracy|Loss):\\s*([0-9eE+.-]+)', 1) AS DOUBLE) AS v FROM ol) SELECT role, max_by(v, event_id) FILTER (what = 'Accuracy') AS accuracy_pct, max_by(v, event_id) FILTER (what = 'Loss') AS loss FROM m WHERE what <> '' GROUP BY role")
def epoch_metrics(spark, d):
    return logs.epoch_metrics(old_lines(spark, d), "role", "event_id")


@query(f"WITH {_OLD} SELECT role, event_id, line FROM ol QUALIFY row_number() OVER (PARTITION BY role ORDER BY event_id DESC) <= 40")
def log_tail(spark, d):
    return logs.tail(old_lines(spark, d), "role", "event_id").select("role", "event_id", "line")


_COLS = {"training": ["training_sec"], "dataset": ["dataset_prep_sec", "dataset_sec"], "eval": ["client_sec", "client_eval_sec"], "prover": ["prover_sec"]}


@query(f"WITH {_OLD}, {_OLDER} SELECT role, " + ", ".join("coalesce(" + ", ".join(f"max(CASE WHEN key = '{k}' THEN seconds END)" for k in keys) + f") AS {n}" for n, keys in _COLS.items()) + " FROM od GROUP BY role")
def timing_table(spark, d):
    return logs.pivoted(older_timings(spark, d), "role", "key", "seconds", _COLS)


@query("WITH r AS (SELECT user_id % 5 + 1 AS node, round(avg(value), 4) AS mean, max(value) AS peak, CAST(count(*) AS DOUBLE) AS iters FROM events GROUP BY 1) SELECT node, metric, value FROM (UNPIVOT r ON mean, peak, iters INTO NAME metric VALUE value)")
def runtime_table(spark, d):
    """Metrics of each node as rows, as a printed table lists them."""
    own = table(spark, d, "events").groupBy((F.col("user_id") % 5 + 1).alias("node")).agg(F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("peak"), F.count("*").alias("iters"))
    return logs.unpivoted(own, ["node"], ["mean", "peak", "iters"])


@query("WITH r AS (SELECT user_id % 5 + 1 AS role, sum(value) AS total, sum(value) FILTER (event_type = 'view') AS training, sum(value) FILTER (event_type = 'click') AS eval FROM events GROUP BY 1) SELECT round(max(total), 3) AS critical_path, round(max(training), 3) AS training, round(max(eval), 3) AS eval, round(greatest(max(total) - max(training) - max(eval), 0.0), 3) AS residual FROM r")
def run_residual(spark, d):
    """What the slowest role's run leaves beside the longest training and the longest evaluation."""
    part = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value")))
    by = table(spark, d, "events").groupBy((F.col("user_id") % 5 + 1).alias("role")).agg(F.sum("value").alias("total"), part("view").alias("training"), part("click").alias("eval"))
    own = by.agg(*(F.max(c).alias(c) for c in ("total", "training", "eval")))
    rest = F.greatest(F.col("total") - F.col("training") - F.col("eval"), F.lit(0.0))
    return own.select(F.round("total", 3).alias("critical_path"), F.round("training", 3).alias("training"), F.round("eval", 3).alias("eval"), F.round(rest, 3).alias("residual"))


@query("SELECT event_id, concat('run_', strftime(ts, '%Y%m%d_%H%M%S')) AS run_id, CAST(epoch_us(ts) AS BIGINT) AS micros FROM events")
def run_ids(spark, d):
    own = table(spark, d, "events")
    return own.select("event_id", F.concat(F.lit("run_"), logs.run_id(F.col("ts"))).alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


_COUNTS = "c AS (SELECT event_type AS counter, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)"


@query(f"WITH {_COUNTS} SELECT counter, CAST(day AS VARCHAR) AS day, n AS since_reset, CAST(sum(n) OVER (PARTITION BY counter ORDER BY day) AS BIGINT) AS total, n - coalesce(lag(n) OVER (PARTITION BY counter ORDER BY day), 0) AS delta FROM c")
def counter_snapshots(spark, d):
    """Counters that a daily snapshot resets, their running totals and the change between snapshots."""
    own = table(spark, d, "events").groupBy(F.col("event_type").alias("counter"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("counter").orderBy("day")  # a row a day and counter
    return own.select("counter", F.col("day").cast("string").alias("day"), F.col("n").alias("since_reset"), F.sum("n").over(w).alias("total"), (F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0))).alias("delta"))


_TURN = "CAST(concat('0x', substr(sha256(concat_ws('|', CAST({seed} AS VARCHAR), CAST(vec_id AS VARCHAR))), 1, 15)) AS BIGINT)"


@query(f"SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (ORDER BY {_TURN.format(seed=2026 + 777)}, vec_id) <= 100")
def eval_subset(spark, d):
    """A fixed subset of 100 for evaluation: the first in a keyed order."""
    own = table(spark, d, "embeddings").select("vec_id", "label")
    return own.join(F.broadcast(subset(own, "vec_id", 100, 2026 + 777)), "vec_id", "left_semi")  # 100 ids


@query(f"SELECT vec_id, row_number() OVER (ORDER BY {_TURN.format(seed=5)}, vec_id) - 1 AS pos FROM embeddings QUALIFY pos < 64")
def random_minibatch(spark, d):
    """64 rows without replacement, or all if there are fewer, in a keyed order."""
    own = subset(table(spark, d, "embeddings"), "vec_id", 64, 5)
    return own.select("vec_id", (F.row_number().over(Window.orderBy(sample_order("vec_id", 5), "vec_id")) - 1).cast("long").alias("pos"))  # 64 rows


@query("WITH r AS (SELECT user_id % 5 + 1 AS node, count(*) AS iters, sum(value) AS total, max(value) AS peak FROM events GROUP BY 1) SELECT node, concat('[BENCHMARK] role=node', node, ' phase=runtime wall_sec=', printf('%.6f', total), ' iters=', iters, ' peak=', printf('%.2f', peak)) AS line FROM r")
def runtime_lines(spark, d):
    """A summary line for each node, that log_parse's rule reads."""
    by = table(spark, d, "events").groupBy((F.col("user_id") % 5 + 1).alias("node")).agg(F.count("*").alias("iters"), F.sum("value").alias("total"), F.max("value").alias("peak"))
    line = metrics.encode(F.concat(F.lit("node"), F.col("node").cast("string")), F.lit("runtime"), F.col("total"), iters=F.col("iters"), peak=F.format_string("%.2f", "peak"))
    return by.select("node", line.alias("line"))
