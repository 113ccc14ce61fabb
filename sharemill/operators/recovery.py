"""Resharing of tables of scalars when a committee changes, and what is decided when members drop or join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.field import modsum
from ..spec import FieldSpec
from .membership import carried, running_total
from .sharing import weighted


def safe(t: int, s: int, n_active: Column) -> Column:
    """Whether packing s secrets at threshold t is safe for so many active parties."""
    return F.lit(2 * (t + s - 1)) < n_active


def senders(old: Sequence[int], new: Sequence[int], t: int) -> list[int]:
    """The lowest t + 1 members of both committees, who send when it changes."""
    both = sorted(set(old) & set(new))
    if len(both) < t + 1:
        raise ValueError("too few members stay to redistribute")
    return both[: t + 1]


def reshare_or_keep(shares: DataFrame, key: Sequence[str], spec: FieldSpec, old: Sequence[int], new: Sequence[int]) -> DataFrame:
    """shares(key, party, y), of which some may be missing -> (key, party, y, reshared). A scalar whose
    senders are all there gets shares for the new committee; another one keeps what it has. One
    aggregation: a scalar's shares are as few as parties."""
    use = senders(old, new, spec.t)
    fresh = F.array(*(F.struct(F.lit(j).alias("party"), modsum(weighted(F.col("y"), F.col("party"), use, j, spec.p), spec.p).alias("y")) for j in sorted(new)))
    own = shares.groupBy(*key).agg(F.count_if(F.col("party").isin(use)).alias("there"), fresh.alias("fresh"), F.collect_list(F.struct("party", "y")).alias("kept"))
    whole = F.col("there") == len(use)
    return own.select(*key, F.explode(F.when(whole, F.col("fresh")).otherwise(F.col("kept"))).alias("s"), whole.alias("reshared")).select(*key, "s.party", "s.y", "reshared")


def decisions(timeline: DataFrame, kind: str, t: int, s: int) -> DataFrame:
    """timeline(kind, n_active, paused, ...) -> adds safe and action. A drop that leaves it safe goes on,
    another pauses and reshares; a join passes a barrier, redistributes and starts a new epoch; a
    completed reshare resumes if it is safe by then."""
    ok = safe(t, s, F.col("n_active"))
    action = F.when(F.col(kind) == "drop", F.when(ok, "continue").otherwise("pause_reshare")).when(F.col(kind) == "join", "barrier_redistribute_bump").when(ok, "resume").otherwise("stay_paused")
    return timeline.withColumns({"safe": ok, "action": action})


def recoveries(decided: DataFrame, ts: str, order: str, span: Column) -> DataFrame:
    """A row per pause: seq, n_active, resumed_at of the next resume (null: none came), wall_sec and
    success. The next resume is the last one so far when read backwards, by spans."""
    own = running_total(decided.withColumn("_p", (F.col("action") == "pause_reshare").cast("int")), "_p", span, [ts, order], "seq")
    own = own.withColumns({"_back": -F.unix_micros(F.col(ts).cast("timestamp")), "_id": -F.col(order), "_late": -span})
    own = carried(own, F.when(F.col("action") == "resume", -F.col("_back")), F.col("_late"), ["_back", "_id"], "_resume", None)
    wall = (F.col("_resume") + F.col("_back")) / 1e6
    rows = own.where("action = 'pause_reshare'")
    return rows.select(order, "seq", "n_active", F.round(wall, 3).alias("wall_sec"), F.col("_resume").isNotNull().alias("success"))
