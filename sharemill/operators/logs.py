"""What older, untagged log lines say, and tables made of timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The names of timings in older logs, as "<name>: <seconds>s", and their keys.
OLDER = {
    "Training Time": "training_sec",
    "Dataset Share Prep Time": "dataset_prep_sec",
    "Client Distribution Time": "client_distribution_sec",
    "Client Eval Time": "client_eval_sec",
    "Client Eval Share Wait Time": "client_eval_share_wait_sec",
    "Client Eval Reconstruct Time": "client_eval_reconstruct_sec",
    "Client Eval Upload Time": "client_eval_upload_sec",
    "Prover Time": "prover_sec",
}
EPOCH = r"Epoch\s+(\d+)\s+Test (Accuracy|Loss):\s*([0-9eE+.\-]+)"


def older_timings(lines: DataFrame, role: str, order: str) -> DataFrame:
    """lines(role, order, line) -> (role, key, seconds): the last line of each name wins, a name also
    within a line, as "Client Eval Time" isn't "Eval Time" of another."""
    arms = [F.struct(F.lit(key).alias("key"), F.element_at(F.regexp_extract_all("line", F.lit(name + r":\s*([0-9.]+)s"), F.lit(1)), -1).alias("v")) for name, key in OLDER.items()]
    found = lines.where(F.col("line").rlike(r"Time:\s*[0-9.]+s")).select(role, order, F.explode(F.filter(F.array(*(F.when(F.size(F.regexp_extract_all("line", F.lit(name + r":\s*([0-9.]+)s"), F.lit(1))) > 0, arm) for name, arm in zip(OLDER, arms, strict=True))), lambda x: x.isNotNull())).alias("h"))
    return found.groupBy(role, "h.key").agg(F.max_by(F.col("h.v"), order).cast("double").alias("seconds"))


def epoch_metrics(lines: DataFrame, role: str, order: str) -> DataFrame:
    """(role, accuracy_pct, loss): of the last epoch that each was printed for."""
    own = lines.select(role, order, F.regexp_extract("line", EPOCH, 2).alias("what"), F.regexp_extract("line", EPOCH, 3).alias("v")).where("what <> ''")
    last = lambda what: F.max_by(F.when(F.col("what") == what, F.col("v").cast("double")), F.when(F.col("what") == what, F.col(order)))
    return own.groupBy(role).agg(last("Accuracy").alias("accuracy_pct"), last("Loss").alias("loss"))


def tail(lines: DataFrame, role: str, order: str, n: int = 40) -> DataFrame:
    """The last n lines of each role."""
    w = Window.partitionBy(role).orderBy(F.col(order).desc())
    return lines.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def pivoted(timings: DataFrame, role: str, key: str, value: str, columns: dict[str, Sequence[str]]) -> DataFrame:
    """One row a role: each column is the first of its keys that the role has, null if it has none."""
    at = lambda k: F.max(F.when(F.col(key) == k, F.col(value)))
    return timings.groupBy(role).agg(*(F.coalesce(*(at(k) for k in keys)).alias(name) for name, keys in columns.items()))


def unpivoted(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keep, metric, value) of each named column."""
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))).alias("m")).select(*keep, "m.metric", "m.value")


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
